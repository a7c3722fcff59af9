"""Quality rules: plain counts of a text, and the perplexity of a character model of its language.

The model is an interpolated modified Kneser-Ney trigram model of characters. Every letter of every
script is a symbol of its own, and every language has a model of its own; rows without a language
share one more. Spark counts the trigrams of each language over its distinct texts, so what is fetched
and sent to tasks are the different trigrams of each language, whatever the number of rows. Copies weigh
nothing in the counts and the bands: else one text with many copies would set what is usual.

Runs of white space, of capitals, of digits and of one sign count as one symbol: else a row of signs
would be easy to foretell and lower the perplexity of junk. A window of 64 symbols that surprises
the model of the row's language is scored by the model that knows it best, so clean text that
quotes another language is not taken for junk.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kategora.plans.ordering import key_order, rank_cuts
from kategora.plans.storage import discard, pinned, staged

# Classes of symbols, and numbers for symbols where every letter has its own: trigrams of these fill 63 bits.
SYMBOLS = 56
LETTERS = 39
WIDE = 1 << 21
OTHER = ""
CHUNK = 1 << 18
# Different trigrams that a task holds before it hands them on.
HELD = 1 << 22
BATCH_ROWS = 1 << 16
MIN_WORDS = 50
# A text is rejected outside [q25 - w, q75 + w] of its language's log-perplexities, where
# w = max(FENCE * (q75 - q25), FLOOR) + SHORT / sqrt(its symbols): short texts vary more, and texts
# that are much alike leave no quartile distance to judge others by.
FENCE = 2.0
FLOOR = 0.2
SHORT = 4.0
WINDOW = 64
SURPRISE = 0.25
SPACE = b" \t\n\r\x0b\x0c"


SIGNS = "#*$%&|<>"


def _symbol(code: int) -> int:
    """0 white space, 1-26 letters, 27 upper case, 28 digits, 29 punctuation, 30 other signs, 31-38 ``SIGNS``, then other letters."""
    char = chr(code)
    if char.isspace():
        return 0
    if "a" <= char <= "z":
        return code - 96
    if char in SIGNS:
        return 31 + SIGNS.index(char)
    if char.isupper():
        return 27
    if char.isnumeric():
        return 28
    if char in ".,;:!?'\"()-":
        return 29
    return 39 + code % 17 if char.isalpha() else 30


def _own_symbol(code: int) -> int:
    """As ``_symbol``, but every letter beyond a to z, and every mark that letters carry, is a symbol of its own."""
    symbol = _symbol(code)
    return LETTERS + code if symbol >= LETTERS or symbol == 30 and unicodedata.category(chr(code)).startswith("M") else symbol


_TABLES: dict[bool, np.ndarray] = {}


def symbol_table(own: bool = False) -> np.ndarray:
    if own not in _TABLES:
        _TABLES[own] = np.array([(_own_symbol if own else _symbol)(c) for c in range(1 << 16)], np.int64)
    return _TABLES[own]


def symbols(texts: list[str], own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(document, trigram)`` for every symbol of each text; two spaces stand before the first.

    A trigram is a number to the base ``WIDE`` if letters are to have their ``own`` symbols, of ``SYMBOLS`` if classes are enough.
    """
    joined = np.frombuffer("".join("  " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = symbol_table(own)[joined & 0xFFFF]
    # The table ends at the basic plane; each distinct code point behind it is looked at by itself.
    far = np.flatnonzero(joined >> 16)
    if len(far):
        points, place = np.unique(joined[far], return_inverse=True)
        code[far] = np.array([(_own_symbol if own else _symbol)(int(c)) for c in points])[place]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = np.ones(len(code), bool)
    once = (code == 0) | ((code >= 27) & (code < LETTERS))
    keep[2:] = (code[2:] != code[1:-1]) | ~once[2:] | (doc[2:] != doc[:-2])
    code, doc = code[keep], doc[keep]
    same = doc[2:] == doc[:-2]
    base = WIDE if own else SYMBOLS
    return doc[2:][same], ((code[:-2] * base + code[1:-1]) * base + code[2:])[same]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if size and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of each count: one for 1, one for 2, one for 3 and more."""
    n = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], float)
    if not n[:2].all():
        d = np.array([0.5, 0.5, 0.5])
    else:
        y = n[0] / (n[0] + 2 * n[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
        d = np.where(np.isfinite(d), np.clip(d, 0.05, [0.95, 1.9, 2.8]), 0.5)
    return d[np.minimum(counts, 3).astype(int) - 1]


def _level(keys: np.ndarray, counts: np.ndarray, base: int, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of each key given its context, and the contexts with their weight for the lower level.

    ``keys`` are sorted numbers of the form context * base + symbol; ``lower`` gives the chance of
    a key one symbol shorter.
    """
    context, begin = np.unique(keys // base, return_index=True)
    total = np.add.reduceat(counts, begin).astype(float)
    cut = discounts(counts)
    weight = np.add.reduceat(cut, begin) / total
    row = np.repeat(np.arange(len(context)), np.diff([*begin, len(keys)]))
    return (counts - cut) / total[row] + weight[row] * lower(keys), context, weight


@dataclass
class KneserNey:
    """Sorted key arrays, those of a language one after the other; ``*_at`` tell where each language begins."""

    languages: list[str]
    base: int
    keys: np.ndarray
    keys_at: np.ndarray
    chances: np.ndarray
    pairs: np.ndarray
    pairs_at: np.ndarray
    pair_chances: np.ndarray
    contexts: np.ndarray
    contexts_at: np.ndarray
    context_weights: np.ndarray
    firsts: np.ndarray
    firsts_at: np.ndarray
    first_weights: np.ndarray
    singles: np.ndarray
    singles_at: np.ndarray
    single_chances: np.ndarray
    # Chance of a symbol that the language does not have.
    unseen: np.ndarray
    usual: np.ndarray

    @staticmethod
    def fit(languages: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray, base: int = SYMBOLS) -> KneserNey:
        order = np.lexsort((code, lang))
        lang, code, count = lang[order], code[order], count[order]
        begins = np.searchsorted(lang, np.arange(len(languages) + 1))
        unseen = np.full(len(languages), 1 / base)
        levels = [[] for _ in range(5)]
        for k in range(len(languages)):
            mine = slice(begins[k], begins[k + 1])
            keys, counts = code[mine], count[mine]
            pairs, pair_counts = np.unique(keys % base**2, return_counts=True)
            symbol, symbol_counts = np.unique(pairs % base, return_counts=True)
            cut = discounts(symbol_counts)
            unseen[k] = cut.sum() / symbol_counts.sum() / base
            singles = unseen[k] + (symbol_counts - cut) / symbol_counts.sum()
            pair_chances, firsts, first_weights = _level(
                pairs, pair_counts, base, lambda x, s=symbol, c=singles: c[np.searchsorted(s, x % base)]
            )
            chances, contexts, weights = _level(
                keys, counts, base, lambda x, p=pairs, c=pair_chances: c[np.searchsorted(p, x % base**2)]
            )
            found = (keys, chances), (pairs, pair_chances), (contexts, weights), (firsts, first_weights), (symbol, singles)
            for level, part in zip(levels, found, strict=True):
                level.append(part)
        joined = []
        for level in levels:
            joined.append(np.concatenate([np.zeros(0, np.int64), *[keys for keys, _ in level]]))
            joined.append(np.cumsum([0, *[len(keys) for keys, _ in level]]))
            joined.append(np.concatenate([np.zeros(0), *[values for _, values in level]]))
        model = KneserNey(languages, base, *joined, unseen, np.zeros(len(languages)))
        loss = -np.log(model.chance(lang, code)) * count if len(lang) else np.zeros(0)
        model.usual = np.bincount(lang, loss, len(languages)) / np.maximum(np.bincount(lang, count, len(languages)), 1)
        return model

    def chance(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Chance of the last symbol of each trigram given the first two."""
        out = np.empty(len(code))
        if len(lang) and (lang == lang[0]).all():
            return self._chance(int(lang[0]), code)
        for k in np.flatnonzero(np.bincount(lang)):
            mine = np.flatnonzero(lang == k)
            out[mine] = self._chance(k, code[mine])
        return out

    def _chance(self, k: int, code: np.ndarray) -> np.ndarray:
        base = self.base
        out, missing = _find(self.keys, self.keys_at, self.chances, k, code)
        if len(missing):
            code = code[missing]
            low, none = _find(self.pairs, self.pairs_at, self.pair_chances, k, code % base**2)
            if len(none):
                weight, new = _find(self.firsts, self.firsts_at, self.first_weights, k, code[none] // base % base)
                weight[new] = 1.0
                single, new = _find(self.singles, self.singles_at, self.single_chances, k, code[none] % base)
                single[new] = self.unseen[k]
                low[none] = weight * single
            weight, new = _find(self.contexts, self.contexts_at, self.context_weights, k, code // base)
            weight[new] = 1.0
            out[missing] = weight * low
        return out

    def log_perplexity(self, texts: list[str], lang: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Mean of ``-log chance`` over the symbols of each text, and how many there are."""
        mean, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not self.languages:
            return mean, size
        doc, code = symbols(texts, self.base == WIDE)
        if not len(doc):
            return mean, size
        there, begin = np.unique(doc, return_index=True)
        size[there] = np.diff([*begin, len(doc)])
        own = np.asarray(lang)[doc]
        loss = -np.log(self.chance(own, code))
        place = np.arange(len(doc)) - np.repeat(begin, size[there])
        opens = np.flatnonzero(place % WINDOW == 0)
        window = np.repeat(np.arange(len(opens)), np.diff([*opens, len(doc)]))
        sums = np.add.reduceat(loss, opens)
        odd = sums / np.bincount(window) > self.usual[own[opens]] + SURPRISE
        again = odd[window]
        if again.any():
            part, group = code[again], np.cumsum(odd)[window[again]] - 1
            for k in range(len(self.languages)):
                other = np.bincount(group, -np.log(self.chance(np.full(len(part), k), part)), odd.sum())
                sums[odd] = np.minimum(sums[odd], other)
        mean[there] = np.bincount(doc[opens], sums, len(texts))[there] / size[there]
        return mean, size


def _find(keys: np.ndarray, begins: np.ndarray, values: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys of a language, 0 where it has none, and the places of these."""
    keys, values = keys[begins[k] : begins[k + 1]], values[begins[k] : begins[k + 1]]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), np.flatnonzero(~hit)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers of all parts, and the sums of their counts."""
    code, count = (np.concatenate(c) for c in zip(*parts))
    if not len(code):
        return code, count
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[begin], np.add.reduceat(count, begin)


class Tally:
    """Trigrams of the texts of a task by language."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[str]) -> None:
        for part in chunks(texts):
            found = np.unique(symbols(part, own=True)[1], return_counts=True)
            parts = self.parts.setdefault(lang, [])
            parts.append(found)
            self.size += len(found[0])
            # What was added up before is added up again when there is as much beside it.
            if sum(len(c) for c, _ in parts[1:]) > len(parts[0][0]):
                self.size -= sum(len(c) for c, _ in parts)
                parts[:] = [_added(parts)]
                self.size += len(parts[0][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lang, parts in self.parts.items():
            code, count = _added(parts)
            for a in range(0, len(code), BATCH_ROWS):
                some = code[a : a + BATCH_ROWS]
                arrays = [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(count[a : a + BATCH_ROWS], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "code", "n"])
        self.parts, self.size = {}, 0


def fit_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> KneserNey:
    """Count the trigrams of all distinct texts of every language in Spark, added up within each task first, and smooth them."""
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(OTHER)).alias("lang")).filter("text <> ''")
    # Copies are combined within each task before the texts meet, so a hot text is one row per task.
    rows = rows.groupBy("lang", F.md5("text").alias("digest")).agg(F.first("text").alias("text")).drop("digest")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(k, []).append(t)
            for k, own in by_lang.items():
                tally.add(k, own)
                if tally.size > HELD:
                    yield from tally.rows()
        yield from tally.rows()

    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    lang_of = np.argsort(order.to_numpy())[coded.indices.to_numpy()]
    return KneserNey.fit(coded.dictionary.take(order).to_pylist(), lang_of, table.column("code").to_numpy(), table.column("n").to_numpy(), WIDE)


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    signs = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, signs, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = np.unique(number[:-1] * len(ids) + number[1:], return_inverse=True)[1]
    window, count = np.unique(pair[:-1] * np.int64(len(ids)) + number[2:], return_inverse=True, return_counts=True)[1:]
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = ["n_words", "n_repeat_words", "model", "log_perplexity", "n_scored"]


def measure(docs: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``digest`` of the text, the counts, ``model`` (language of the model used), ``log_perplexity`` and ``n_scored``."""
    rows = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.md5(text).alias("digest")
    )
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, mean, size = scored(model, batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            counts = [text_counts(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("digest"), *columns, pa.array(own, pa.string()), pa.array(mean), pa.array(size)],
                ["key", "digest", *COUNTS, "model", "log_perplexity", "n_scored"],
            )

    schema = f"key {kind}, digest string, {', '.join(f'{c} long' for c in COUNTS)}, model string, log_perplexity double, n_scored long"
    return rows.mapInArrow(run, schema)


def scored(model: KneserNey, texts: list, langs: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Model, mean and size for each text; rows of a language without a model use the shared one."""
    names = model.languages
    place = {n: i for i, n in enumerate(names)}
    number = [place.get(x, place.get(OTHER, 0)) for x in langs]
    mean, size, at = [], [], 0
    for part in chunks([t or "" for t in texts]):
        m, n = model.log_perplexity(part, number[at : at + len(part)])
        mean.append(m)
        size.append(n)
        at += len(part)
    own = [names[k] if names else OTHER for k in number]
    return own, np.concatenate([np.zeros(0), *mean]), np.concatenate([np.zeros(0, np.int64), *size])


def bands(measured: DataFrame) -> DataFrame:
    """``(model, low, high)``: quartiles of the log-perplexity for each model, over all distinct texts that pass the plain rules."""
    good = measured.filter(~failed(F.col("n_words"), F.col("n_repeat_words")))
    good = staged(good.groupBy("model", "digest").agg(F.min("log_perplexity").alias("log_perplexity")), "distinct-scores")

    if good.isEmpty():
        return good.selectExpr("model", "log_perplexity as low", "log_perplexity as high")

    def ranks(groups: DataFrame) -> DataFrame:
        return groups.withColumns({"low": F.ceil(F.col("n") / 4), "high": F.ceil(3 * F.col("n") / 4)})

    # Exact ranks: an approximation would depend on how the rows are dealt out to tasks.
    cuts = rank_cuts(good, ["model"], key_order("log_perplexity"), ["low", "high"], ranks)
    discard(good)
    return cuts.select("model", F.col("low._key").alias("low"), F.col("high._key").alias("high"))


def inside(low: Column, high: Column, mean: Column, size: Column) -> Column:
    """Whether a measured row (log-perplexity, symbols) lies in the perplexity band of its model; a model without a band rejects nothing."""
    width = F.greatest(FENCE * (high - low), F.lit(FLOOR)) + SHORT / F.sqrt(F.greatest(size, F.lit(1)))
    return F.coalesce((mean >= low - width) & (mean <= high + width), F.lit(True))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    ``kept``: not that, and a perplexity inside the band of the language. NULL and empty texts have
    no words and fail; NULL languages use the shared model; NULL keys and repeated rows pass
    through; other columns are ignored; an empty table gives an empty result. The texts are read
    twice (count, score) and shuffled once, to count each distinct text once; the scores are written
    once in the shared folder.
    """
    model = fit_model(docs, text, lang)
    measured = staged(measure(docs, model, key, text, lang), "quality")
    base = failed(F.col("n_words"), F.col("n_repeat_words"))
    fits = inside(F.col("low"), F.col("high"), F.col("log_perplexity"), F.col("n_scored"))
    return measured.join(bands(measured), "model", "left").select(
        F.col("key").alias(key), *COUNTS, base.alias("base_failed"), (~base & fits).alias("kept"), "log_perplexity"
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that ``quality`` keeps, whole and unchanged.

    NULL and empty texts fail the plain rules, NULL languages use the shared model, repeated rows stay or go
    together, an empty table gives an empty result. Every text is scored once: the rows are written with
    their scores to the shared folder, and filtered as they are read from there.
    """
    model = fit_model(docs, text, lang)
    # Names that no column of the table has.
    mark = "_" + "".join(docs.columns)
    names = [mark + c for c in MEASURED]
    rows = docs.withColumn(mark + "digest", F.md5(text))
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.LongType()]
    schema = T.StructType([*rows.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(text).to_pylist()
            langs = [None if x is None else str(x) for x in batch.column(lang).to_pylist()]
            own, mean, size = scored(model, values, langs)
            counts = [text_counts(t) for t in values]
            found = [pa.array([c[0] for c in counts], pa.int64()), pa.array([c[4] for c in counts], pa.int64())]
            found += [pa.array(own, pa.string()), pa.array(mean, pa.float64()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *names])

    table = staged(rows.mapInArrow(run, schema), "quality")
    measured = table.select(*[F.col(n).alias(c) for n, c in zip(names, MEASURED)], F.col(mark + "digest").alias("digest"))
    limits = bands(measured).toDF(mark + "own", mark + "low", mark + "high")
    n_words, again, own, mean, size = map(F.col, names)
    good = ~failed(n_words, again) & inside(F.col(mark + "low"), F.col(mark + "high"), mean, size)
    return table.join(limits, own == F.col(mark + "own"), "left").filter(good).select(*docs.columns)
