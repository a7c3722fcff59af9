"""Grouping of spelling variants: words one code point apart, found with bidirectional FM-indexes.

Of two words one error apart, one half is the same in both. So words meet where they share a half:
every word is put under the first and the last half of its possible partners, and shards of these
keys are made small enough for one index each. In a shard, the search scheme of ``fm_index`` matches
that half exactly and grows over the other with one error. A half that very many words share is
dealt to several shards; its queries visit all of them, so that no index is larger than ``SHARD``.

Words are counted by Spark; the work of a shard depends on its words, not on how often they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kategora.llm.fm_index import BiIndex, one_error
from kategora.plans.storage import discard, staged

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form has so many times the occurrences of its variant.
RATIO = 10
# Characters of the words in a shard, and words of one half in a shard.
SHARD_CHARS = 200_000
SHARD = 10_000


def runs(text: Column) -> Column:
    """Maximal runs of letters that can become words, A-Z in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    return F.transform(found, lambda run: F.translate(run, UPPER, LOWER))


def misspelt(key: Column, run: Column) -> Column:
    """The run, in one of 31 cases without one of its code points."""
    mark = F.crc32(F.concat(key.cast("string"), F.lit(":"), run))
    at = (mark % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(mark % 31 == 0, shorter).otherwise(run)


def counted(words: DataFrame) -> DataFrame:
    """``word, n`` of a column ``word``: the words that are long and frequent enough."""
    long = words.filter(F.char_length("word") >= LEAST_LENGTH)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def corpus_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` of every run in every whole text, misspelt where its checksum says so; NULL keys misspell nothing."""
    each = docs.select(F.col(key).alias("key"), F.explode(runs(F.col(text))).alias("run"))
    return each.select(F.coalesce(misspelt(F.col("key"), F.col("run")), F.col("run")).alias("word"))


def postings(words: DataFrame) -> DataFrame:
    """``side, half, word, n, asks``: the halves by which a partner can find a word, and the one by which it searches."""
    size = F.char_length("word")

    def places(side: int, length: Column) -> Column:
        whole = F.when(F.lit(side) == 0, F.floor(length / 2)).otherwise(F.ceil(length / 2)).cast("int")
        half = F.substring("word", F.lit(1), whole) if side == 0 else F.substring("word", size - whole + 1, whole)
        return F.struct(F.lit(side).alias("side"), half.alias("half"))

    # A partner is as long, or one code point longer or shorter.
    each = F.array(*[places(side, size + d) for side in (0, 1) for d in (-1, 0, 1)])
    own = F.array(*[places(side, size) for side in (0, 1)])
    at = words.select("word", "n", own.alias("own"), F.explode(F.array_distinct(each)).alias("at"))
    return at.select("at.side", "at.half", "word", "n", F.array_contains("own", F.col("at")).alias("asks"))


def sharded(posted: DataFrame) -> DataFrame:
    """``side, shard, part, word, n, asks, held``: index entries (``held``) and queries (``asks``) of each shard."""
    halves = posted.groupBy("side", "half").agg(F.count("*").alias("words"), F.sum(F.char_length("word") + 1).alias("chars"))
    halves = staged(halves, "halves")
    total = halves.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    large = halves.filter(F.col("words") > SHARD).select("side", "half", F.ceil(F.col("words") / SHARD).cast("int").alias("parts"))
    dealt = posted.join(large, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    visited = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    shard = F.pmod(F.xxhash64("half"), F.lit(shards)).cast("long")
    dealt = dealt.withColumns({"own": own, "shard": F.when(F.col("parts") == 1, shard).otherwise(F.lit(shards) + F.xxhash64("half"))})
    dealt = dealt.select("side", "shard", F.explode(visited).alias("part"), "word", "n", "asks", "own")
    return dealt.select("side", "shard", "part", "word", "n", "asks", (F.col("part") == F.col("own")).alias("held"))


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and their numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return points, np.fromiter(map(len, words), np.int64, len(words))


def near_in(table: pa.Table) -> pa.Table:
    """``word, near, near_n`` of one shard."""
    side = table.column("side")[0].as_py()
    frame = table.select(["word", "n", "asks", "held"]).group_by("word").aggregate([("n", "max"), ("asks", "max"), ("held", "max")])
    words = frame.column("word").to_pylist()
    counts, asks, held = (frame.column(c).to_numpy() for c in ("n_max", "asks_max", "held_max"))
    kept, asking = np.flatnonzero(held), np.flatnonzero(asks)
    empty = table.select(["word", "word", "n"]).slice(0, 0).rename_columns(["word", "near", "near_n"])
    if not len(kept) or not len(asking):
        return empty
    points, lengths = codes(words)
    letters, chars = np.unique(points, return_inverse=True)
    chars, starts = chars + 1, np.r_[0, np.cumsum(lengths)[:-1]]
    inside = np.repeat(held, lengths)
    index = BiIndex(chars[inside], lengths[kept], len(letters) + 1)
    query, found = one_error(index, chars, starts[asking], lengths[asking], to_left=bool(side))
    a, b = asking[query], kept[found]
    names = np.array(words, object)
    return pa.table({"word": pa.array(names[a], pa.string()), "near": pa.array(names[b], pa.string()), "near_n": pa.array(counts[b], pa.int64())}) if len(a) else empty


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all pairs of words of a table ``word, n`` that differ by one code point, both ways."""
    shards = sharded(postings(words)).groupBy("side", "shard", "part")
    return shards.applyInArrow(near_in, "word string, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain ``word, form``, found by doubling its steps.

    Counts rise tenfold with each step, so a chain has few of them and the loop few rounds.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a table ``word, n``.

    A word's form is its near word with the largest ``n`` (ties: the smallest in code-point order), if that is
    ``RATIO`` times its own, else NULL; its root is the last of the chain of forms, itself without a form.
    """
    pairs = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    known = words.join(pairs, "word", "left")
    form_n = -F.col("best.n")
    formed = F.when(form_n >= RATIO * F.col("n"), F.struct(F.col("best.form").alias("form"), form_n.alias("form_n")))
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("formed")), "variants")
    chains = roots(known.filter("formed is not null").select("word", "formed.form"))
    return known.join(chains, "word", "left").select(
        "word", "formed.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "formed.form_n"
    )


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of all whole texts.

    NULL and empty texts have no words; repeated rows count as often as they occur; other columns
    are ignored; an empty table gives an empty result. Words may have any length.
    """
    return variants(staged(counted(corpus_words(docs, key, text)), "words"))


SQL = r"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS raw FROM documents
), met AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM found WHERE length(raw) >= 7 GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(doc_id || ':' || run)) AS h FROM met
), marked AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(h) // 2),
      lambda i: [('0x' || substring(h, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) AS mark
  FROM bytes
), spelt AS (
  SELECT times, CASE WHEN mark % 31 = 0
    THEN substring(run, 1, mark % length(run)) || substring(run, mark % length(run) + 2) ELSE run END AS word
  FROM marked
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cut AS (
  SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON rest = words.word
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS near, max(w.n) AS near_n
  FROM near JOIN words w ON near.near = w.word GROUP BY near.word
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT chain.word, form, step + 1 FROM chain JOIN formed ON root = formed.word WHERE form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)
"""
