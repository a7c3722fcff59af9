"""Merkle manifest of a table: a content-addressed DAG, and proofs by descending it.

The rows of a group, in order, are the leaves of a tree in which every ``FAN`` consecutive nodes have
one parent; the groups' roots, in order, are the leaves of one more such tree. A record tells the
children of a digest. Records are stored in pages of ``LEVELS`` levels under the digest of the page's
top node, so equal subtrees are stored once and a tree of 10**10 leaves is five pages high.

A request for a leaf descends from the root by the digits of its rank. Requests are merged by the
page they pass through, so the root is read once and not once for each leaf, and only the last
page is left with one row per leaf. Each step down keeps the children that were not selected;
reversed, the steps are the proof from the leaf up.

Ranks come from a range partitioning and counts per partition and group. No group, whatever its
share of the rows, is sorted or gathered by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kategora.plans.storage import discard, pinned, staged

FAN = 3
LEVELS = 5
PAGE = FAN**LEVELS
POWERS = [FAN**i for i in range(40)]
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def field(value: Column) -> Column:
    """A value that no neighbour can run into: its number of bytes, a colon and its text; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**values: Column) -> Column:
    return digest_of(*[field(values.get(name, F.col(name))) for name in FIELDS])


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree with so many of them."""
    powers = F.array(*map(F.lit, POWERS)).cast("array<bigint>")
    return F.size(F.filter(powers, lambda p: p < size))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a stored table with ``rank`` (from 0) in their ``group`` and the group's ``size``.

    The rows are sorted over all partitions once; what a partition holds of a group is one run of
    its rows, so a row's rank is its place in the run and the sizes of the runs before.
    """
    keys = [F.col("group"), *[F.col(c).asc_nulls_first() for c in order]]
    run = staged(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "runs"
    ).withColumn("part", F.shiftright("place", 33))
    counts = run.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # One row per group and partition that holds some of it.
    whole = Window.partitionBy("group")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "group", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size")
    )
    placed = run.join(pinned(starts), ["group", "part"])
    return placed.withColumn("rank", F.col("start") + F.col("place") - F.col("first")).drop("place", "part", "first", "start")


@dataclass(frozen=True)
class Tree:
    """The pages of all groups, lowest first: ``group, number, top, levels, items, left``.

    ``number`` is the page's place in its group, ``levels`` its digests from the lowest level up,
    ``items`` the nodes of the lowest level, ``left`` how many nodes the group has at the page's top.
    """

    rounds: list[DataFrame]

    def tops(self) -> DataFrame:
        """``group, round, digest``: the page from which each group descends, and its root."""
        each = [p.filter("left = 1").select("group", F.lit(i).alias("round"), F.col("top").alias("digest")) for i, p in enumerate(self.rounds)]
        out = each[0]
        for other in each[1:]:
            out = out.unionByName(other)
        return out

    def records(self, i: int) -> DataFrame:
        """Content-addressed: one record per digest, wherever the page occurs."""
        return self.rounds[i].groupBy("top").agg(F.first("levels").alias("levels"), F.first("items").alias("items"))


def parents(digests: Column) -> Column:
    runs = F.sequence(F.lit(0), div(F.size(digests) - 1, FAN).cast("int"))
    return F.transform(runs, lambda i: digest_of(joined(F.slice(digests, i * FAN + 1, FAN))))


def build(nodes: DataFrame) -> Tree:
    """Pages over ``group, rank, size, item``, where ``item`` is a struct with the node's ``digest``."""
    rounds = []
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        many = nodes.groupBy("group", div(F.col("rank"), PAGE).alias("number"), "size")
        pages = many.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
        height = F.least(depth(F.col("size")), F.lit(LEVELS))
        lowest = F.array(F.transform("items", lambda x: x["digest"])).cast("array<array<string>>")
        grown = F.aggregate(
            F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: i <= height),
            lowest,
            lambda all_, _: F.concat(all_, F.array(parents(F.element_at(all_, -1)))).cast("array<array<string>>"),
        )
        power = F.element_at(F.array(*map(F.lit, POWERS[: LEVELS + 1])), height + 1)
        pages = pages.select("group", "number", "items", grown.alias("levels"), div(F.col("size") + power - 1, power).alias("left"))
        pages = pages.withColumn("top", F.get(F.element_at("levels", -1), F.lit(0)))
        rounds.append(staged(pages, "pages"))
        largest = -(-largest // PAGE)
        if largest <= 1:
            return Tree(rounds)
        nodes = rounds[-1].filter("left > 1").select(
            "group", F.col("number").alias("rank"), F.col("left").alias("size"), F.struct(F.col("top").alias("digest")).alias("item")
        )


def wanted(requests: DataFrame, rounds: int) -> list[DataFrame]:
    """``group, number, digits`` of each round: which children the requests ``group, rank`` select of each page."""
    found = []
    for _ in range(rounds):
        page = requests.groupBy("group", div(F.col("rank"), PAGE).alias("number"))
        found.append(staged(page.agg(F.collect_set((F.col("rank") % PAGE).cast("int")).alias("digits")), "requests"))
        requests = found[-1].select("group", F.col("number").alias("rank"))
    return found


def selected(levels: Column, digit: Column) -> Column:
    """Steps from a page's top down to the child ``digit`` of its lowest level: the place taken and the children not selected."""
    height = F.size(levels) - 1
    powers = F.array(*map(F.lit, POWERS[:LEVELS]))

    def step(level: Column) -> Column:
        at = div(digit, F.get(powers, level)).cast("int")
        run = F.slice(F.get(levels, level), div(at, FAN).cast("int") * FAN + 1, FAN)
        return F.struct((at % FAN).alias("place"), F.filter(run, lambda _, i: i != at % FAN).alias("others"))

    below = F.filter(F.sequence(F.lit(0), height), lambda i: i < height)
    return F.transform(F.reverse(below), step)


def descend(tree: Tree, starts: DataFrame, requests: list[DataFrame]) -> DataFrame:
    """``group, item, path`` of every request, and what ``starts`` (``group, round, digest, path``) has besides.

    ``path`` holds the steps from the root down. A frontier row is a page that some request passes
    through; it meets its record by digest.
    """
    kept = [c for c in starts.columns if c not in ("round", "digest", "path")]
    frontier = None
    for i in reversed(range(len(tree.rounds))):
        entering = starts.filter(F.col("round") == i).select(*kept, F.lit(0).cast("long").alias("number"), "digest", "path")
        frontier = entering if frontier is None else frontier.unionByName(entering)
        pages = frontier.join(requests[i], ["group", "number"]).join(tree.records(i).withColumnRenamed("top", "digest"), "digest")
        down = F.transform(
            "digits",
            lambda d: F.struct(
                (F.col("number") * PAGE + d).alias("number"),
                F.get("items", d).alias("item"),
                F.concat("path", selected(F.col("levels"), d)).alias("path"),
            ),
        )
        frontier = pages.select(*kept, F.inline(down))
        if i:
            frontier = staged(frontier.select(*kept, "number", F.col("item.digest").alias("digest"), "path"), "frontier")
    return frontier


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof, from the leaf up, lead to."""

    def up(node: Column, step: Column) -> Column:
        return digest_of(joined(F.slice(step["others"], F.lit(1), step["place"])), node, joined(F.slice(step["others"], step["place"] + 1, FAN)))

    return F.aggregate(proof, leaf, up)


def manifest(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` of every row of a documents table.

    ``presented`` is the text that somebody shows for a row (default: the row's own); its leaf and the
    proof of the stored row must lead to the root. ``proof`` lists ``place, others`` from the leaf up.

    NULLs differ from empty texts; a NULL source is a group of its own, before all others; rows with
    NULL or equal ``doc_id`` are leaves like any other, in the order of ``doc_id`` (NULL first) and digest,
    and repeated rows are leaves as often as they occur. A single leaf is its group's root. Other
    columns are ignored; an empty table gives an empty result.
    """
    shown = F.col("text") if presented is None else presented
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group"),
        "doc_id",
        leaf_of().alias("leaf"),
        leaf_of(text=shown).alias("shown"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = staged(leaves, "leaves")
    nodes = staged(
        ranked(leaves, ["doc_id", "leaf", "row"]).select(
            "group", "rank", "size", F.struct(F.col("leaf").alias("digest"), "doc_id", "shown").alias("item")
        ),
        "nodes",
    )
    rows = build(nodes)
    tops = staged(rows.tops(), "tops")
    # Above the groups there is one tree, whose leaves are their roots in the order of the groups.
    above = tops.select(F.lit("").alias("group"), F.col("group").alias("of"), "round", "digest")
    roots = staged(
        ranked(above, ["of"]).select("group", "rank", "size", F.struct("digest", "of", "round").alias("item")), "subroots"
    )
    upper = build(roots)
    none = F.array().cast("array<struct<place:int,others:array<string>>>")
    top = upper.tops().select("group", "round", "digest", F.col("digest").alias("root"), none.alias("path"))
    found = descend(upper, top, wanted(roots.select("group", "rank"), len(upper.rounds)))
    starts = found.select(
        F.col("item.of").alias("group"), F.col("item.round").alias("round"), F.col("item.digest").alias("digest"),
        F.col("item.digest").alias("subroot"), "root", "path",
    )
    proved = descend(rows, staged(starts, "starts"), wanted(nodes.select("group", "rank"), len(rows.rounds)))
    discard(leaves)
    proof = F.reverse("path")
    named = proved.select("item.doc_id", F.col("item.digest").alias("leaf"), "subroot", "root", proof.alias("proof"), "item.shown")
    return named.withColumn("folded_root", folded(F.col("shown"), F.col("proof"))).select(
        "doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def tampered() -> Column:
    """Text without line feeds where 2 divides the checksum of the document's number."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def digests(found: DataFrame) -> DataFrame:
    others = F.flatten(F.transform("proof", lambda s: s["others"]))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(joined(others), 256).alias("proof_sha256"), "folded_root", "verified")


SQL = r"""
WITH RECURSIVE checked AS (
  SELECT *, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc
  FROM documents
), shown AS (
  SELECT *, CASE WHEN crc IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM checked
), fields AS (
  SELECT doc_id, source, text, other,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM shown
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS shown
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
  SELECT 0 AS lvl, source, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, source, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lvl, source, i // 3
), subroots AS (
  SELECT source, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 3
), everything AS (
  -- Levels of the upper tree follow those of each group's own.
  SELECT source, lvl, i, h FROM nodes WHERE n > 1
  UNION ALL
  SELECT source, depth + lvl, t.i, t.h FROM tops t, subroots s WHERE t.n > 1
), way AS (
  SELECT row_number() OVER () AS id, doc_id, leaf, placed.source, subroot, 0 AS lvl, placed.i, subroots.i AS top, depth, shown AS h, '' AS proof
  FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source
  UNION ALL
  SELECT id, doc_id, leaf, w.source, subroot, w.lvl + 1, any_value(CASE WHEN w.lvl < depth THEN w.i ELSE top END) // 3,
    any_value(CASE WHEN w.lvl < depth THEN top ELSE top // 3 END), depth,
    sha256(string_agg(CASE WHEN e.i = CASE WHEN w.lvl < depth THEN w.i ELSE top END THEN w.h ELSE e.h END, '' ORDER BY e.i)),
    any_value(proof) || coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (e.i <> CASE WHEN w.lvl < depth THEN w.i ELSE top END), '')
  FROM way w JOIN everything e ON w.source IS NOT DISTINCT FROM e.source AND w.lvl = e.lvl
    AND e.i // 3 = CASE WHEN w.lvl < depth THEN w.i ELSE top END // 3
  GROUP BY id, doc_id, leaf, w.source, subroot, w.lvl, depth
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lvl DESC) AS last FROM way), (SELECT h AS root FROM tops WHERE n = 1)
WHERE last = 1
"""
