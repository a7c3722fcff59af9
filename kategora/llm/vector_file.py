"""Exact top-k by inner product with a vector-approximation file.

Every vector is approximated by the grid cell it lies in: ``BITS`` bits a component, between the
smallest and largest value that component has in the whole table. A scan of the cells bounds each
inner product from both sides. A vector whose upper bound lies below the k-th best lower bound is
out; exact vectors are read only for the others, in the order of their upper bounds, until the k-th
best exact product lies above every bound that is left.

Queries meet the file in blocks: a block of queries and a group of vectors are one cell of work, so a
task holds ``BLOCK`` queries and streams vectors past them. Equal vectors are scanned once: of the
rows that have a vector only the k+1 with the smallest ids can be in an answer (k, and the query's own
row), which a limit before the shuffle leaves of any number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kategora.plans.storage import discard, staged

BITS = 6
# Queries in a block, vectors in a group, and vectors compared with a block at once.
BLOCK = 512
GROUP = 16_384
SLICE = 2_048
SCALE = 256


def integers(embedding: str) -> Column:
    """``floor(256 * x)`` of every component."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(embedding: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    value = F.col(embedding)
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return value.isNotNull() & finite


def approximate(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``low`` (smallest values), ``width`` (of a cell) and ``code`` (cell of each component).

    The grid is a statistic of all rows: two numbers for each component of each vector length.
    """
    each = vectors.select("dims", F.posexplode("ints").alias("at", "x"))
    span = each.groupBy("dims", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = F.floor((F.col("high") - F.col("low")) / (1 << BITS)) + 1
    span = span.select("dims", F.struct("at", "low", width.alias("width")).alias("cell"))
    sides = span.groupBy("dims").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    sides = staged(sides.select("dims", F.col("cells.low").alias("low"), F.col("cells.width").alias("width")), "grid")
    code = F.zip_with(
        F.zip_with("ints", "low", lambda x, a: x - a), "width", lambda x, w: F.floor(x / w).cast("int")
    )
    none = F.array().cast("array<bigint>")
    sided = vectors.join(sides, "dims", "left").withColumns({c: F.coalesce(c, none) for c in ("low", "width")})
    return sided.withColumn("code", code)


def matrix(column: pa.Array, dims: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


class Block:
    """A block of queries and what a scan has found for them so far."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
        self.ids, self.k = ids, k
        # Code c stands for low + width * c and the width - 1 values after it.
        self.weights = np.ascontiguousarray((exact * width).T)
        base = exact @ low
        rest = exact * (width - 1)
        self.below = base + np.minimum(rest, 0).sum(1)
        self.above = base + np.maximum(rest, 0).sum(1)
        # What rounding can add up to: nothing while all sums are whole numbers below 2**53.
        size = np.abs(exact) @ (np.abs(low) + width * (1 << BITS))
        self.slack = np.where(size < 2**52, 0.0, size * 1e-12)
        self.best = np.full((len(ids), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []

    def scan(self, ids: np.ndarray, codes: np.ndarray) -> None:
        inner = codes @ self.weights
        low = (inner + (self.below - self.slack)).T
        high = (inner + (self.above + self.slack)).T
        self.best = -np.partition(-np.hstack([self.best, low]), self.k - 1, axis=1)[:, : self.k]
        query, row = np.nonzero(high >= self.best.min(1)[:, None])
        self.found.append((query, ids[row], low[query, row], high[query, row]))

    def result(self) -> Iterator[pa.RecordBatch]:
        """Vectors that this part of the file cannot rule out."""
        least = self.best.min(1)
        for query, ids, low, high in self.found:
            keep = high >= least[query]
            if keep.any():
                columns = [self.ids[query[keep]], ids[keep], low[keep], high[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "vec", "low", "high"])


def scanned(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, a cell's queries before its vectors."""
    cell, block, waiting = None, None, []

    def ready() -> Block:
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        dims = len(rows.column("low")[0])
        sides = [np.array(rows.column(c)[0].as_py(), np.float64) for c in ("low", "width")]
        return Block(rows.column("id").to_numpy(), matrix(rows.column("ints"), dims), *sides, k)

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "block", "part", "kind")], 1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if cell != tuple(keys[a, :3]):
                if block:
                    yield from block.result()
                cell, block, waiting = tuple(keys[a, :3]), None, []
            if keys[a, 3] == 0:
                waiting.append(batch.slice(a, b - a))
                continue
            if block is None and waiting:
                block, waiting = ready(), []
            if block is None:
                continue
            for at in range(a, b, SLICE):
                rows = batch.slice(at, min(SLICE, b - at))
                block.scan(rows.column("id").to_numpy(), matrix(rows.column("code"), int(keys[a, 0])))
    if block:
        yield from block.result()


def candidates(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query, vec, low, high``: for each asked vector those whose upper bound reaches its ``k``-th best lower bound.

    ``vectors`` and ``asked`` are ``id, dims, ints, low, width, code``. Only vectors of equal length are compared.
    """
    n_vectors, n_asked = vectors.count(), asked.count()
    blocks, parts = max(1, -(-n_asked // BLOCK)), max(1, -(-n_vectors // GROUP))
    spread = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select("dims", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "ints", "low", "width", F.lit(None).cast("array<int>").alias("code"))
    file = vectors.join(asked.select("dims").distinct(), "dims", "left_semi").select(
        "dims", every(blocks).alias("block"), F.pmod(spread, F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "id",
        *[F.lit(None).cast("array<bigint>").alias(c) for c in ("ints", "low", "width")], "code",
    )
    cells = queries.unionByName(file).repartition("dims", "block", "part").sortWithinPartitions("dims", "block", "part", "kind")
    met = staged(cells.mapInArrow(lambda b: scanned(b, k), "query long, vec long, low double, high double"), "bounds")
    best = Window.partitionBy("query").orderBy(F.desc("low"))
    least = met.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
    least = least.groupBy("query").agg(F.count("*").alias("n"), F.min("low").alias("least"))
    # Fewer than k vectors in all: every one of them stays.
    least = least.select("query", F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")).alias("least"))
    return met.join(least, "query").filter("high >= least").drop("least")


def exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query, vec, score``: the exact vectors of the pairs are read and multiplied."""
    ints = vectors.select("id", "ints")
    both = pairs.select("query", "vec").join(ints.select(F.col("id").alias("vec"), F.col("ints").alias("x")), "vec")
    both = both.join(ints.select(F.col("id").alias("query"), F.col("ints").alias("q")), "query")
    product = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return both.select("query", "vec", product.alias("score"))


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query, vec, score`` of vectors among which the ``k`` best of every asked one are.

    First the vectors with the ``k`` highest upper bounds are read; their worst score is a mark that no
    answer lies below, so what is read next is all that has a bound up there, and then it is certain.
    """
    found = staged(candidates(vectors, asked, k), "candidates")
    order = Window.partitionBy("query").orderBy(F.desc("high"), "vec")
    first = staged(exact(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k), vectors), "first-read")
    mark = first.groupBy("query").agg(F.min("score").alias("mark"))
    rest = found.join(mark, "query").filter(F.col("high") >= F.col("mark")).join(first, ["query", "vec"], "left_anti")
    return first.unionByName(exact(rest, vectors))


def top_k(rows: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product with each row that satisfies ``asks``.

    Scores are inner products of ``floor(256 * x)``; ties go to the smaller id, NULL ids last. Every row
    but the query's own is a candidate, also rows that repeat its id or vector, and repeated query
    rows are answered each. Rows whose vector is NULL, or holds a NULL or a component that is not
    finite, take no part; vectors of other lengths than the query's are not compared with it. Scores
    have to fit a long. Other columns are ignored; an empty table gives an empty result.
    """
    named = rows.select(F.col(key).alias("key"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(embedding).alias("embedding"))
    named = named.filter(usable("embedding")).select("key", "asks", integers("embedding").alias("ints"), F.monotonically_increasing_id().alias("row"))
    named = staged(named, "vectors")
    # The k+1 smallest rows of each vector; the limit works in every task before the shuffle.
    same = Window.partitionBy("ints").orderBy(F.col("key").asc_nulls_last(), "row")
    least = staged(named.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1), "least")
    distinct = least.filter("nth = 1").select(F.col("row").alias("id"), F.size("ints").cast("long").alias("dims"), "ints")
    vectors = staged(approximate(distinct), "file")
    asking = named.filter("asks").select("ints", "key", "row")
    queries = staged(asking.join(vectors.select("ints", "id"), "ints").select("id", "key", "row"), "queries")
    asked = staged(vectors.join(queries.select("id").distinct(), "id", "left_semi"), "asked")
    scores = staged(nearest(vectors, asked, k + 1), "scores")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row")
    members = vectors.select("ints", F.col("id").alias("vec")).join(least.select("ints", "key", "row"), "ints").drop("ints")
    answers = scores.join(members, "vec").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    answers = answers.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "key", "row", "score"))).alias("found"))
    own = queries.select(F.col("id").alias("query"), F.col("key").alias("query_id"), F.col("row").alias("self")).join(answers, "query")
    others = F.slice(F.filter("found", lambda a: a["row"] != F.col("self")), 1, k)
    result = own.select("query_id", F.posexplode(others).alias("rank", "a"))
    discard(named)
    return result.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("a.key").alias("vec_id"), F.col("a.score").alias("score"))


SQL = """
WITH ints AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scores AS (
  SELECT q.id, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ints q, ints v WHERE q.vec_id % 50 = 0 AND q.id <> v.id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
