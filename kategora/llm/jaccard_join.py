"""N-gram Jaccard join: which documents share at least 0.8 of their five-word shingles.

Candidates come from MinHash bands of fixed depth, not from a forest of adaptive prefixes: each of
``TREES`` bands labels a document with 7 minimum hashes, and documents with an equal label are
candidates. 7 is the longest depth, of at most ``MAX_DEPTH``, that finds a pair at the threshold with
the target recall; it follows from the constants, not from the data. A bucket is reduced to a star
around its smallest document, never expanded to pairs. The components of all stars are then verified exactly:
their texts are dealt to blocks, and each pair of blocks is compared in one task of bounded size
by its whole shingle sets. Such a task returns one row per document, with its number of links.

Documents with the same words are one text: they are compared once and share its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kategora.llm.components import components
from kategora.plans.storage import staged

WORDS = 5
THRESHOLD = 0.8
TREES = 40
MAX_DEPTH = 12
RECALL = 0.9999
# Texts of a component that one task compares with as many others.
BLOCK = 256
COLUMNS = 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = MAX_DEPTH) -> int:
    """Longest prefix with which some tree brings a pair at the threshold together with chance ``recall``."""
    d = longest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


class Shingles:
    """Shingle sets of texts as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def words_of(self, text: str | None) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").split() if text else []

    def of(self, words: list[bytes]) -> np.ndarray:
        """A text of fewer words than a shingle is one shingle; one without words has none."""
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(words))
        total = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            total = (total * _PRIME + h[k : len(h) - size + 1 + k]) ^ (total >> np.uint64(29))
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(27)))


class Forest:
    """Label prefixes of a shingle set, one number for each tree."""

    def __init__(self, trees: int, deep: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.trees, self.deep = trees, deep
        self.factors = random.integers(1, 1 << 63, trees * deep, np.uint64) | np.uint64(1)
        self.adds = random.integers(0, 1 << 63, trees * deep, np.uint64)
        self.mixers = random.integers(1, 1 << 63, (trees, deep), np.uint64) | np.uint64(1)

    def prefixes(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024]
            values = (self.factors[:, None] * part[None, :] + self.adds[:, None]) >> np.uint64(32)
            np.minimum(least, values.min(1), out=least)
        mixed = (least.reshape(self.trees, self.deep) * self.mixers).sum(1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _PRIME
        return (mixed + np.arange(self.trees, dtype=np.uint64) * self.mixers[0, 0]).view(np.int64)


def key_of(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def signatures(rows: DataFrame, trees: int, deep: int, words: int) -> DataFrame:
    """``id, row, text_key, node, prefixes``: identity of the words, a short form of it, and the label prefixes."""
    kind = rows.schema["id"].dataType.simpleString()
    forest = Forest(trees, deep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            keys, prefixes = [], []
            last: dict[bytes, list[int]] = {}
            for text in batch.column("text").to_pylist():
                own = shingles.words_of(text)
                keys.append(key_of(own))
                if keys[-1] not in last:
                    found = shingles.of(own)
                    last[keys[-1]] = forest.prefixes(found) if len(found) else np.zeros(0, np.int64)
                prefixes.append(last[keys[-1]])
            nodes = [int.from_bytes(k[:8], "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("row"),
                    pa.array(keys, pa.binary()),
                    pa.array(nodes, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["id", "row", "text_key", "node", "prefixes"],
            )

    return rows.mapInArrow(run, f"id {kind}, row long, text_key binary, node long, prefixes array<long>")


def candidate_groups(signed: DataFrame) -> DataFrame:
    """``node, root``: components of the documents that share a prefix with a different text."""
    labels = signed.select("node", F.explode("prefixes").alias("prefix"))
    shared = labels.groupBy("prefix").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    stars = labels.join(shared, "prefix").select(F.col("node").alias("u"), F.col("low").alias("v"))
    return components(stars)


def linked(matrix: np.ndarray, keys: list[bytes]) -> list[bytes]:
    """Smallest key that each row of a symmetric link matrix reaches."""
    order = np.argsort(np.array(keys, object))
    label = np.empty(len(keys), np.int64)
    label[order] = np.arange(len(keys))
    reach = matrix | np.eye(len(keys), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(keys)).min(1)
        if (new == label).all():
            return [keys[order[k]] for k in label]
        label = new


def compare(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` have that Jaccard similarity, exactly."""
    size_a, size_b = (np.array([len(s) for s in sets], np.int64) for sets in (sets_a, sets_b))
    flat_a, flat_b = (np.concatenate([np.zeros(0, np.uint64), *sets]) for sets in (sets_a, sets_b))
    row_a, row_b = np.repeat(np.arange(len(sets_a)), size_a), np.repeat(np.arange(len(sets_b)), size_b)
    both = np.intersect1d(flat_a, flat_b)
    at_a, at_b = np.searchsorted(both, flat_a), np.searchsorted(both, flat_b)
    hit_a = both[np.minimum(at_a, max(len(both) - 1, 0))] == flat_a if len(both) else np.zeros(len(flat_a), bool)
    hit_b = both[np.minimum(at_b, max(len(both) - 1, 0))] == flat_b if len(both) else np.zeros(len(flat_b), bool)
    row_a, at_a, row_b, at_b = row_a[hit_a], at_a[hit_a], row_b[hit_b], at_b[hit_b]
    shared = np.zeros((len(sets_a), len(sets_b)), np.float64)
    for low in range(0, len(both), COLUMNS):
        one = np.zeros((len(sets_a), min(COLUMNS, len(both) - low)), np.float32)
        two = np.zeros((len(sets_b), one.shape[1]), np.float32)
        for matrix, row, at in ((one, row_a, at_a), (two, row_b, at_b)):
            here = (at >= low) & (at < low + one.shape[1])
            matrix[row[here], at[here] - low] = 1
        shared += one @ two.T
    union = size_a[:, None] + size_b[None, :] - shared
    return (shared >= threshold * union - 1e-9) & (union > 0)


def verified(texts: DataFrame, threshold: float, words: int, block: int) -> DataFrame:
    """``text_key, n_texts, n_docs, root``: links of each candidate text found in each pair of blocks that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for (i, j), group in _groups(batches):
            # A row is found by a 64-bit hash; its words tell whether it is the right one.
            keys = [k for k in group if k == key_of(shingles.words_of(group[k][2]))]
            if len(keys) < 2:
                continue
            sets = [shingles.of(shingles.words_of(group[k][2])) for k in keys]
            side = np.array([group[k][0] for k in keys])
            sizes = np.array([group[k][1] for k in keys], np.int64)
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            found = compare([sets[i] for i in a], [sets[i] for i in b], threshold)
            link = np.zeros((len(keys), len(keys)), bool)
            link[np.ix_(a, b)] = found
            link |= link.T
            np.fill_diagonal(link, False)
            some = np.flatnonzero(link.any(1))
            if len(some):
                part = link[np.ix_(some, some)]
                own = [keys[i] for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.binary()),
                        pa.array(part.sum(1), pa.int64()),
                        pa.array(part @ sizes[some], pa.int64()),
                        pa.array(linked(part, own), pa.binary()),
                    ],
                    ["text_key", "n_texts", "n_docs", "root"],
                )

    parts = F.greatest(F.ceil(F.col("members") / block), F.lit(1)).cast("int")
    dealt = texts.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("text_key"), "parts").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = pairs.select(
        "component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "text_key", "copies", "text"
    )
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "text_key")
    return cells.mapInArrow(run, "text_key binary, n_texts long, n_docs long, root binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict[bytes, tuple[int, int, str]]]]:
    """``(i, j)`` and its texts from rows sorted by ``component, i, j``: ``text_key`` to side, copies and text."""
    now, group = None, {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("component", "i", "j", "side", "text_key", "copies", "text"))
        for component, i, j, side, key, copies, text in zip(*columns, strict=True):
            if (component, i, j) != now:
                if len(group) > 1:
                    yield now[1:], group
                now, group = (component, i, j), {}
            group[key] = (side, copies, text)
    if len(group) > 1:
        yield now[1:], group


def jaccard_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    words: int = WORDS,
    trees: int = TREES,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: ``key, text_id, class_id, n_links, n_text_links, row, stays``.

    ``text_id``: smallest key with the same words. ``class_id``: smallest key that links lead to.
    ``n_links``: other rows of similarity ``threshold`` or more, copies included; ``n_text_links``:
    different texts among them. ``stays``: one row of each class, that with the smallest key (of
    equal keys the one with the smallest ``row``, a hash of key and text; NULL keys come last).

    Words are what white space (ASCII) parts. NULL texts count as empty; texts without words are
    one class. Rows equal in key and text share ``row`` and ``stays``. Classes whose keys are all
    NULL have NULL ids. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    signed = staged(signatures(rows, trees, depth(threshold, trees, recall), words), "signatures")
    groups = candidate_groups(signed)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    texts = staged(
        signed.groupBy("text_key", "node").agg(F.min(best).alias("best"), F.count("*").alias("copies")), "texts"
    )
    members = texts.join(groups, "node").select("text_key", "copies", F.col("best.row").alias("row"), F.col("root").alias("component"))
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    wanted = staged(members.join(sizes, "component"), "candidates")
    # Both sides are dealt by row at every size: the candidates grow with the documents.
    held = rows.select("row", "text").join(wanted.hint("merge"), "row")
    links = staged(verified(held, threshold, words, block), "links")
    roots = components(links.select(F.col("text_key").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("text_key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    info = texts.join(counts, "text_key", "left").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
    info = info.withColumn("root", F.coalesce("root", "text_key"))
    tops = info.filter("n_texts is not null").groupBy("root").agg(F.min("best").alias("top"))
    info = info.join(tops, "root", "left").withColumn("top", F.coalesce("top", "best"))
    info = staged(
        info.select(
            "text_key",
            F.col("best.id").alias("text_id"),
            F.col("top.id").alias("class_id"),
            F.col("top.row").alias("top_row"),
            (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_text_links"),
        ),
        "text-classes",
    )
    found = signed.select("id", "row", "text_key").join(info, "text_key", "left")
    return found.select(
        F.col("id").alias(key), "text_id", "class_id", "n_links", "n_text_links", "row", (F.col("row") == F.col("top_row")).alias("stays")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class that stays, whole and unchanged; of rows equal in key and text, one.

    Rows are told apart by a hash of key and text and by the key, so no two keys are taken for one.
    """
    kept = jaccard_join(docs, key, text).filter("stays").select("row").distinct()
    row, nth = "".join(docs.columns) + "_row", "".join(docs.columns) + "_nth"
    marked = docs.withColumn(row, F.xxhash64(docs[key], docs[text])).join(kept.withColumnRenamed("row", row), row)
    first = marked.withColumn(nth, F.row_number().over(Window.partitionBy(row, docs[key]).orderBy(row))).filter(F.col(nth) == 1)
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
