"""Cleaning and tokenising as plain column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Full-width digits and what they stand for.
WIDE_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
# Characters deleted from article bodies.
BODY_CONTROLS = "\n\t\r\u3000"
# Characters not allowed in file names.
FORBIDDEN_IN_NAMES = '/:*?"<>|'

WORD = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_to_text(c: Column, value: str = "nan") -> Column:
    """Stand-in text for a missing value."""
    return F.coalesce(c, F.lit(value))


def fold_digits(c: Column) -> Column:
    """Full-width digits to ASCII digits."""
    return F.translate(c, WIDE_DIGITS, ASCII_DIGITS)


def drop_symbols(c: Column) -> Column:
    """Remove everything but letters, numbers, underscore and white space."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", "")


def drop_digits(c: Column) -> Column:
    """Remove runs of decimal digits of any script."""
    return F.regexp_replace(c, r"\p{Nd}+", "")


def mask_digits(c: Column) -> Column:
    """Each run of decimal digits becomes one 0."""
    return F.regexp_replace(c, r"\p{Nd}+", "0")


def drop_controls(c: Column) -> Column:
    """Remove line breaks, tabs and ideographic spaces anywhere."""
    return F.translate(c, BODY_CONTROLS, "")


def sanitize_filename(url: Column) -> Column:
    """File name for a page address."""
    held = "_" * len(FORBIDDEN_IN_NAMES)
    return F.concat(F.translate(url, FORBIDDEN_IN_NAMES, held), F.lit(".html"))


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def ngrams(words: Column, lo: int, hi: int) -> Column:
    """Word n-grams of every length from ``lo`` to ``hi``, joined by a space."""

    def of_length(a: Column, n: int) -> Column:
        if n == 1:
            return a
        starts = F.sequence(F.lit(0), F.size(a) - n)
        join = lambda i: F.concat_ws(" ", *[F.get(a, i + k) for k in range(n)])
        return F.when(F.size(a) >= n, F.transform(starts, join)).otherwise(
            F.array().cast("array<string>")
        )

    if (lo, hi) == (1, 1):
        return words
    return let(words, lambda a: F.concat(*[of_length(a, n) for n in range(lo, hi + 1)]))


def counted(terms: Column) -> Column:
    """Distinct entries of an array with their counts: ``array<struct<term, tf>>``.

    Equal entries are neighbours after sorting, so counting stays inside the row: a document is
    never exploded and shuffled only to count its own terms.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        entry = lambda first: lambda at, j: F.struct(
            F.get(ordered, at).alias("term"),
            (F.coalesce(F.get(first, j + 1), F.size(ordered)) - at).alias("tf"),
        )
        return F.when(
            F.size(ordered) > 0, let(starts, lambda first: F.transform(first, entry(first)))
        ).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return let(F.sort_array(terms), runs)


def term_counts(text: Column, lo: int = 1, hi: int = 1) -> Column:
    """Raw term frequencies of a text: ``array<struct<term, tf>>``."""
    return counted(ngrams(tokens(text), lo, hi))


def gram_length(term: Column) -> Column:
    """Number of words in an n-gram."""
    return F.length(term) - F.length(F.translate(term, " ", "")) + 1


def drop_stopwords(words: Column, stop: Sequence[str]) -> Column:
    """Remove the words of a short list from a token array."""
    listed = F.array(*[F.lit(w) for w in stop])
    return F.filter(words, lambda w: ~F.array_contains(listed, w))
