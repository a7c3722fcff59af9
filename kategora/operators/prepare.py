"""Row filters, text assembly and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kategora.functions.text import strip


def _holds(needle: str, col: str) -> Column:
    return F.coalesce(F.contains(F.col(col), F.lit(needle)), F.lit(False))


def exclude_url(df: DataFrame, needle: str, col: str = "url") -> DataFrame:
    """Rows whose address does not hold ``needle``; rows without an address stay."""
    return df.filter(~_holds(needle, col))


def count_matching(df: DataFrame, needle: str, col: str = "url") -> DataFrame:
    """How many rows hold ``needle``."""
    return df.agg(F.count_if(_holds(needle, col)).alias("matching"))


def assembled(title: Column, content: Column, sep: str, clean: str = "none") -> Column:
    """Title, separator and content as one text; NULL if either part is.

    ``clean`` strips white space off the ``parts``, off the ``whole``, or off ``none``.
    """
    if clean == "parts":
        return F.concat(strip(title), F.lit(sep), strip(content))
    joined = F.concat(title, F.lit(sep), content)
    if clean == "whole":
        return strip(joined)
    if clean == "none":
        return joined
    raise ValueError(f"clean must be parts, whole or none, not {clean!r}")


def assemble_text(df: DataFrame, sep: str, clean: str = "none", out: str = "text") -> DataFrame:
    """Add the text column made of ``title`` and ``content``."""
    return df.withColumn(out, assembled(F.col("title"), F.col("content"), sep, clean))


def drop_empty(df: DataFrame, cols: Sequence[str] = ("title", "content")) -> DataFrame:
    """Rows in which none of the columns is empty or missing."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) != "" for c in cols]))


def to_documents(df: DataFrame, text: str = "text", label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """Only what a trainer reads: ``text`` and ``label``, plus the columns in ``keep``."""
    return df.select(*keep, F.col(text).alias("text"), F.col(label).alias("label"))


def union_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), tables)
