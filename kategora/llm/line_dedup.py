"""Line dedup with a log-template tree; DataFrame functions only.

A line's tokens are its words; a word with a digit is variable (``<*>``). The tree has fixed depth:
lines part by their number of tokens, then by their first ``DEPTH`` tokens. The distinct lines of a leaf
are generalised together. A token that more than half of the lines have at a place is constant there;
lines that agree with the constants in enough places have one template, if they are at least half.
The others, or else all lines parted by the tokens of one place, are looked at again in the same way.
Words that tell templates apart change together, so the place is one of those without a constant whose
number of different tokens most of them have. Every step at least almost halves what is left, so
few are needed, and a leaf can hold any number of templates, however often each occurs.

A template found in several documents recurs, and so does a line that several documents have
literally: such lines stay in the first document only. Which template a line belongs to does not
depend on how many lines the table has besides those of its leaf.

Lines travel as hashes; a whole line is shuffled once. A very common line is one row per task after
partial aggregation; the tokens of a leaf are counted by place and token, so no leaf is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kategora.llm.exact_dedup import RUNS
from kategora.plans.storage import discard, staged

DEPTH = 3
# Lines with variable words have so many tokens, at least half of them constant.
MIN_TOKENS = 3
# Lines that are generalised have so many tokens, of which so many per cent are constant.
MIN_GENERAL = 6
CONSTANT = 70
# Other lines recur only literally, and have so many characters.
MIN_CHARS = 12
WILD = "<*>"


def spaced(line: Column) -> Column:
    """Line with single spaces."""
    return F.trim(F.regexp_replace(line, RUNS, " "))


def masked(line: Column) -> Column:
    """Line with ``<*>`` for words that have a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", WILD)).otherwise(line)


def lines_of(rows: DataFrame) -> DataFrame:
    """``id, hash, pos, line, n, leaf, key`` of every line that can recur; ``n`` tokens, 0 for one that only recurs literally."""
    # Lines are made below the explode: what is tested after it is not made again.
    both = F.transform(
        F.split("text", "\n"), lambda raw: F.transform(F.array(spaced(raw)), lambda l: F.struct(l.alias("literal"), masked(l).alias("line")))
    )
    lines = rows.select("id", "hash", F.posexplode(F.flatten(both)).alias("pos", "made")).select("id", "hash", "pos", "made.literal", "made.line")
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    wild = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(WILD)))) / len(WILD)
    plain = (F.col("size") >= MIN_TOKENS) & (2 * F.when(F.col("line") == F.col("literal"), 0).otherwise(wild) <= F.col("size"))
    lines = lines.withColumn("size", size).withColumn("n", F.when(plain, F.col("size")).otherwise(0))
    lines = lines.filter((F.col("n") > 0) | (F.char_length("literal") >= MIN_CHARS))
    line = F.when(F.col("n") > 0, F.col("line")).otherwise(F.col("literal"))
    # Two hashes of a line that is not generalised; with the leaf, those that are have two as well.
    tree = F.xxhash64("n", F.substring_index("line", " ", DEPTH))
    lines = lines.select("id", "hash", "pos", line.alias("line"), "n")
    leaf = F.when(F.col("n") >= MIN_GENERAL, tree).otherwise(F.xxhash64("n", "line", F.lit("alone")))
    return lines.select("id", "hash", "pos", "line", "n", leaf.alias("leaf"), F.xxhash64("line").alias("key"))


def documents_seen() -> list[Column]:
    """Aggregates that tell which documents have something: hashed sums, whatever the number of rows."""
    return [F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("named"), F.count("*").alias("rows")]


def several() -> Column:
    """Whether ``documents_seen`` saw more than one; rows with a NULL key are one document."""
    mixed = (F.col("named") > 0) & (F.col("named") < F.col("rows"))
    return mixed | F.coalesce(F.col("low") < F.col("high"), F.lit(False))


def first() -> Column:
    """The document that keeps its lines: that with a NULL key, else the smallest key."""
    return F.when(F.col("named") == F.col("rows"), F.col("low")).alias("first")


def together() -> list[Column]:
    """``documents_seen`` of several rows that have it."""
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("named").alias("named"), F.sum("rows").alias("rows")]


SEEN = ["low", "high", "named", "rows"]


def recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, hash, lines``: for each document, the numbers (from 0) of the lines to drop; rows without any are left out."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).filter("text is not null")
    lines = lines_of(rows)
    seen = staged(lines.groupBy("leaf", "key", "n").agg(*documents_seen()), "lines")
    # Leaves with several lines, from several documents, are looked into; elsewhere a line recurs as it is.
    leaves = seen.filter(F.col("n") >= MIN_GENERAL).groupBy("leaf").agg(F.count("*").alias("kinds"), *together())
    leaves = leaves.filter((F.col("kinds") > 1) & several()).select("leaf", F.lit(True).alias("open"))
    marked = seen.join(leaves, "leaf", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    wanted = marked.filter(F.col("open") | several()).select("leaf", "key", "open", *SEEN)
    found = lines.join(wanted, ["leaf", "key"]).select(
        "id", "hash", "pos", "leaf", "key", "open", *SEEN, F.when(F.col("open"), F.col("line")).alias("line")
    )
    found = staged(found, "line-candidates")
    classes = _templates(found.filter("open"))
    whole = F.when(~F.col("open"), first())
    hits = found.filter(~F.col("open")).select("id", "hash", "pos", whole.alias("first"))
    general = found.filter("open").select("id", "hash", "pos", "leaf", "key").join(classes, ["leaf", "key"])
    hits = hits.unionByName(general.select("id", "hash", "pos", "first"))
    drops = hits.filter(~F.col("first").eqNullSafe(F.col("id")))
    return drops.groupBy("id", "hash").agg(F.collect_set("pos").alias("lines"))


def _judged(met: DataFrame) -> DataFrame:
    """``group, constants, at`` from the lines that have a token at a place: the constant token of each place (NULL for none), and where to part the group."""
    free = 2 * F.col("top") <= F.col("size")
    best = F.max(F.struct("met", "token"))
    places = met.groupBy("group", "size", "at").agg(F.count("*").alias("kinds"), best.alias("best"))
    places = places.select("group", "size", "at", "kinds", F.col("best.met").alias("top"), F.col("best.token").alias("token"))
    constant = F.when(~free & (F.col("token") != F.xxhash64(F.lit(WILD))), F.col("token"))
    alike = places.groupBy("group", "kinds", free.alias("free")).agg(
        F.count("*").alias("places"), F.min("at").alias("at"), F.min(F.struct("top", "at")).alias("least"), F.collect_list(F.struct("at", constant.alias("token"))).alias("own")
    )
    # Places without a constant first; else the one whose commonest token is the least common.
    either = lambda a, b: F.when(F.col("free"), a).otherwise(b)
    way = F.struct(
        either(F.lit(1), F.lit(0)).alias("free"),
        either(F.col("places"), -F.col("least.top")).alias("much"),
        either(-F.col("kinds"), F.lit(0)).alias("few"),
        either(-F.col("at"), -F.col("least.at")).alias("at"),
    )
    split = F.max(F.when(F.col("kinds") > 1, way))
    all_ = F.transform(F.sort_array(F.flatten(F.collect_list("own"))), lambda x: x["token"])
    return alike.groupBy("group").agg(all_.alias("constants"), (-split["at"]).alias("at"))


def _templates(lines: DataFrame) -> DataFrame:
    """``leaf, key, first`` of the lines of open leaves that recur, as part of a template or by themselves."""
    tokens = F.transform(F.split("line", " "), lambda t: F.xxhash64(t))
    distinct = lines.groupBy("leaf", "key", *SEEN, "line").agg(F.count("*").alias("met"))
    now = staged(distinct.select("leaf", "key", *SEEN, F.col("leaf").alias("group"), tokens.alias("tokens")), "leaves")
    alone = staged(now.select("leaf", "key", *SEEN), "open-lines")
    found = None
    while True:
        groups = now.groupBy("group").agg(F.count("*").alias("kinds"), *together()).filter((F.col("kinds") > 1) & several())
        live = now.join(groups.select("group", F.col("kinds").alias("size")), "group")
        met = live.select("group", "size", F.posexplode("tokens").alias("at", "token")).groupBy("group", "size", "at", "token").agg(F.count("*").alias("met"))
        judged = _judged(met)
        agree = F.aggregate(F.zip_with("tokens", "constants", lambda t, c: F.when(t == c, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
        scored = live.join(judged, "group").withColumn("hit", 100 * agree >= CONSTANT * F.size("tokens"))
        scored = staged(scored.select("leaf", "key", *SEEN, "group", "tokens", "size", "hit", "at"), "leaves")
        hits = scored.groupBy("group").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"))
        step = scored.join(hits, "group").withColumn("good", 2 * F.col("hits") >= F.col("size"))
        part = F.when(F.col("good"), F.xxhash64("group", F.lit(-1))).otherwise(F.xxhash64("group", "at", F.get("tokens", F.col("at"))))
        step = staged(step.select("leaf", "key", *SEEN, F.when(F.col("good") & F.col("hit"), F.col("group")).alias("template"), part.alias("group"), "tokens"), "leaves")
        discard(now, scored)
        good = step.filter("template is not null")
        lowest = good.groupBy("template").agg(*together()).filter(several()).select("template", first())
        good = good.select("leaf", "key", "template").join(lowest, "template").select("leaf", "key", "first")
        found = good if found is None else found.unionByName(good)
        now = step.filter("template is null").select("leaf", "key", *SEEN, "group", "tokens")
        if now.isEmpty():
            break
    # What no template has taken recurs as it is.
    rest = alone.filter(several()).join(found, ["leaf", "key"], "left_anti")
    return found.unionByName(rest.select("leaf", "key", first()))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """The rows with recurring lines taken out of ``text``; ``count`` names a column for how many were.

    NULL texts stay NULL, texts that lose every line become empty. Of several documents with a
    template the one with the smallest key keeps its lines (NULL keys are smallest); rows of equal
    keys count as one document and keep or lose such lines together.
    Lines of fewer than three tokens, or of mostly variable ones, go only where they are literally equal
    and have ``MIN_CHARS`` characters; blank lines stay. Other columns pass through whatever their names;
    an empty table gives an empty result.
    """
    found = recurring(docs, key, text)
    mark = "".join(docs.columns) + "_"
    hits = found.select(*[F.col(c).alias(mark + c) for c in found.columns])
    same = docs[key].eqNullSafe(hits[mark + "id"]) & (F.xxhash64(docs[text]) == hits[mark + "hash"])
    drop = F.col(mark + "lines")
    lines = F.split(docs[text], "\n")
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(drop, i)), "\n")
    kept = F.when(drop.isNull(), docs[text]).otherwise(rest)
    columns = [kept.alias(c) if c == text else docs[c] for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(count))
    return docs.join(hits, same, "left").select(*columns)


SQL = r"""
WITH RECURSIVE flat AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), spaced AS (
  SELECT doc_id, pos, literal, regexp_replace(literal, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line
  FROM (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS literal FROM flat)
), sized AS (
  SELECT *, string_split(line, ' ') AS t,
    len(string_split(line, ' ')) >= 3 AND 2 * len(list_filter(string_split(line, ' '), lambda x: x = '<*>' )) <= len(string_split(line, ' ')) AS plain
  FROM spaced
), lines AS (
  SELECT doc_id, pos, plain, t, CASE WHEN plain THEN line ELSE literal END AS line FROM sized WHERE plain OR length(literal) >= 12
), seen AS (
  SELECT plain, line, any_value(t) AS t, min(doc_id) AS first, max(doc_id) AS last FROM lines GROUP BY plain, line
), tree AS (
  SELECT line, t, first, last, len(t) || ' ' || array_to_string(t[1:3], ' ') AS grp, NULL::VARCHAR AS template
  FROM seen WHERE plain AND len(t) >= 6
  UNION ALL
  SELECT line, t, first, last, CASE WHEN good THEN md5(grp || ' rest') ELSE md5(grp || split) END, CASE WHEN good AND hit THEN grp END
  FROM (
    SELECT *, 2 * sum(hit::INTEGER) OVER (PARTITION BY grp) >= n AS good FROM (
      SELECT line, any_value(t) AS t, any_value(first) AS first, any_value(last) AS last, grp, any_value(n) AS n,
        100 * count(*) FILTER (2 * met > n AND token <> '<*>') >= 70 * count(*) AS hit,
        arg_max(i || ' ' || token, (CASE WHEN free THEN 1 ELSE 0 END, CASE WHEN free THEN alike ELSE -top END, CASE WHEN free THEN -kinds ELSE 0 END, -i))
          FILTER (kinds > 1) AS split
      FROM (
        SELECT *, 2 * top <= n AS free, count(*) OVER (PARTITION BY grp, line, kinds, 2 * top <= n) AS alike FROM (
          SELECT *, max(met) OVER (PARTITION BY grp, i) AS top FROM (
            SELECT *, count(DISTINCT token) OVER (PARTITION BY grp, i) AS kinds, count(*) OVER (PARTITION BY grp, i, token) AS met FROM (
              SELECT line, t, first, last, grp, n, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (
                SELECT *, count(*) OVER (PARTITION BY grp) AS n, min(first) OVER (PARTITION BY grp) AS lowest, max(last) OVER (PARTITION BY grp) AS highest
                FROM tree WHERE template IS NULL
              ) WHERE n > 1 AND lowest <> highest
            )
          )
        )
      ) GROUP BY line, grp
    )
  )
), taken AS (
  SELECT line, min(first) OVER (PARTITION BY template) AS keeps, min(first) OVER (PARTITION BY template) <> max(last) OVER (PARTITION BY template) AS good
  FROM tree WHERE template IS NOT NULL
), kept AS (
  SELECT s.plain, s.line, coalesce(g.keeps, s.first) AS first
  FROM seen s LEFT JOIN (SELECT line, keeps FROM taken WHERE good) g ON s.plain AND s.line = g.line
  WHERE g.line IS NOT NULL OR s.first <> s.last
), drops AS (
  SELECT doc_id, pos FROM lines JOIN kept USING (plain, line) WHERE doc_id <> first
)
SELECT doc_id, sha256(text) AS text_sha256, n_dropped FROM (
  SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(n_dropped, 0) AS n_dropped
  FROM documents d
  LEFT JOIN (
    SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT dropped) AS text, count(*) FILTER (dropped) AS n_dropped
    FROM (SELECT f.doc_id, f.pos, f.raw, x.pos IS NOT NULL AS dropped FROM flat f LEFT JOIN drops x ON f.doc_id = x.doc_id AND f.pos = x.pos)
    GROUP BY doc_id
  ) k USING (doc_id)
)
"""
