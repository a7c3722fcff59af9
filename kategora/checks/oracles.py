"""SQL that computes, on the same tables, what each registered query must return."""

from __future__ import annotations

from kategora.checks.queries import (
    GRID,
    HOLDOUT,
    RANDOM,
    SEPARATORS,
    STOPWORDS,
    TUNED,
    TUNING,
)
from kategora.functions.text import WHITESPACE
from kategora.sources.articles import NULL_TOKENS

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
DOCS = "docs AS (SELECT doc_id, text, lang AS category, source FROM documents)"
ARTICLES = (
    "art AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, "
    "substr(text, length(split_part(text, chr(10), 1)) + 2) AS content FROM documents)"
)


def chars(s: str) -> str:
    """SQL expression for a string of arbitrary characters."""
    return " || ".join(f"chr({ord(c)})" for c in s) if s else "''"


STRIPPED = f"trim({{}}, {chars(WHITESPACE)})"


def digest(expression: str) -> str:
    return f"SELECT doc_id, md5({expression}) AS digest FROM documents"


def assembled(sep: str, clean: str) -> str:
    title, content = ("title", "content")
    if clean == "parts":
        title, content = STRIPPED.format("title"), STRIPPED.format("content")
    joined = f"{title} || {chars(sep)} || {content}"
    if clean == "whole":
        joined = STRIPPED.format(joined)
    return f"WITH {ARTICLES} SELECT doc_id, md5({joined}) AS digest FROM art"


def grams(lo: int, hi: int, columns: str, source: str) -> str:
    """Rows ``columns, term, words, tf`` of the n-grams of a table with a ``text`` column."""
    lengths = " UNION ALL ".join(
        f"SELECT {columns}, {n} AS words, unnest([array_to_string(w[i:i+{n - 1}], ' ') "
        f"for i in range(1, len(w) - {n} + 2)]) AS term FROM worded"
        for n in range(lo, hi + 1)
    )
    return (
        f"WITH worded AS (SELECT {columns}, {WORDS} AS w FROM {source}) "
        f"SELECT {columns}, term, words, count(*) AS tf FROM ({lengths}) GROUP BY ALL"
    )


def gram_counts(lo: int, hi: int) -> str:
    return (
        f"WITH {DOCS}, tf AS ({grams(lo, hi, 'doc_id', 'docs')}) "
        "SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM tf GROUP BY term"
    )


def hash_rank(seed: int, key: str = "doc_id", over: str = "") -> str:
    return f"row_number() OVER ({over} ORDER BY md5(CAST({key} AS VARCHAR) || '-{seed}'), {key})"


def split(share: str) -> str:
    return (
        f"SELECT doc_id, CASE WHEN {hash_rank(42)} <= ceil((SELECT count(*) FROM documents) * {share}) "
        "THEN 'test' ELSE 'train' END AS part FROM documents"
    )


RECENT = (
    "docs AS (SELECT doc_id, text, lang AS category, source FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 400)"
)


def parted(docs: str) -> str:
    """Common tables up to ``parts``: a stratified split whose test part has a fifth, rounded up."""
    return f"""{docs}, per AS (SELECT category, count(*) AS n FROM docs GROUP BY category),
kept AS (SELECT *, sum(n) OVER () - ceil(sum(n) OVER () * 0.2e0) AS kept, sum(n) OVER () AS total FROM per),
exact AS (SELECT *, CAST(n AS DOUBLE) * kept / total AS exact FROM kept),
turned AS (SELECT *, kept - sum(floor(exact)) OVER () AS missing,
  row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, category) AS turn FROM exact),
held AS (SELECT category, n - floor(exact) - CASE WHEN turn <= missing THEN 1 ELSE 0 END AS upto FROM turned),
parts AS (SELECT d.*, CASE WHEN {hash_rank(42, over="PARTITION BY category")} <= upto
  THEN 'test' ELSE 'train' END AS part FROM docs d JOIN held USING (category))"""


PARTS = parted(DOCS)

SPLIT3 = f"""SELECT *, CASE WHEN rn <= ceil(0.5e0 * ceil(0.2e0 * n)) THEN 'test'
  WHEN rn <= ceil(0.2e0 * n) THEN 'validation' ELSE 'train' END AS part
  FROM (SELECT doc_id, text, lang AS category, {hash_rank(369)} AS rn, count(*) OVER () AS n FROM documents)"""


def folded(source: str) -> str:
    """Rows of ``source`` with their fold: classes laid end to end, dealt out in turn."""
    return f"""SELECT r.* EXCLUDE (rn), CAST((SELECT min(f) FROM range(5) t(f)
    WHERE (SELECT sum(floor((laid + n - g + 4) / 5) - floor((laid - g + 4) / 5)) FROM range(5) u(g) WHERE g <= f) >= rn)
    AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rn FROM {source}) r
  JOIN (SELECT category, n, coalesce(sum(n) OVER (ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS laid
    FROM (SELECT category, count(*) AS n, min(doc_id) AS seen FROM {source} GROUP BY category)) o USING (category)"""


def bayes(lo: int, hi: int, min_df: int, alpha: float, parts: str = PARTS) -> str:
    """Common tables up to the predictions ``pred(doc_id, label, score)`` on the test part."""
    return f"""{parts},
classes AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS label, count(*) AS n_docs,
  ln(count(*) / (sum(count(*)) OVER ())) AS prior FROM parts WHERE part = 'train' GROUP BY category),
alltf AS ({grams(lo, hi, 'doc_id, part, category', 'parts')}),
terms AS (SELECT term, count(*) AS df,
  ln((1e0 + (SELECT sum(n_docs) FROM classes)) / (1e0 + count(*))) + 1 AS idf
  FROM alltf WHERE part = 'train' GROUP BY term HAVING count(*) >= {min_df}),
raw AS (SELECT doc_id, part, category, term, tf * idf AS w FROM alltf JOIN terms USING (term)),
x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM raw),
lik AS (SELECT label, term, sum(x) AS s FROM x JOIN classes USING (category) WHERE part = 'train' GROUP BY label, term),
tot AS (SELECT label, sum(s) AS t FROM lik GROUP BY label),
pred AS (SELECT doc_id, label, score FROM (
  SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) AS rn FROM (
    SELECT p.doc_id, c.label, c.prior + coalesce(sum(x.x * (ln(coalesce(l.s, 0) + {alpha}e0)
      - ln(tot.t + {alpha}e0 * (SELECT count(*) FROM terms)))), 0) AS score
    FROM parts p JOIN classes c ON p.part = 'test' JOIN tot USING (label)
    LEFT JOIN x ON x.doc_id = p.doc_id LEFT JOIN lik l ON l.term = x.term AND l.label = c.label
    GROUP BY p.doc_id, c.label, c.prior)) WHERE rn = 1)"""


TUNED_SQL = bayes(TUNED.lo, TUNED.hi, TUNED.min_df, TUNED.alpha)
PLAIN_SQL = bayes(1, 1, 1, 1.0)


def predicted(ctes: str) -> str:
    return f"WITH {ctes} SELECT doc_id, label, round(score, 6) AS score FROM pred"


def measured(source: str, columns: str = "accuracy, precision, recall, f1") -> str:
    """Weighted metrics of a query giving ``label`` and ``prediction``."""
    return f"""SELECT {columns} FROM (SELECT round(sum(hit) / sum(support), 6) AS accuracy,
  round(sum(support * p) / sum(support), 6) AS precision, round(sum(support * r) / sum(support), 6) AS recall,
  round(sum(CASE WHEN p + r = 0 THEN 0 ELSE support * 2 * p * r / (p + r) END) / sum(support), 6) AS f1
  FROM (SELECT support, hit, CASE WHEN coalesce(guessed, 0) = 0 THEN 0e0 ELSE hit / guessed END AS p, hit / support AS r
    FROM (SELECT label, count(*)::DOUBLE AS support, count(*) FILTER (label = prediction)::DOUBLE AS hit
      FROM ({source}) GROUP BY label)
    LEFT JOIN (SELECT prediction AS label, count(*)::DOUBLE AS guessed FROM ({source}) GROUP BY prediction) USING (label)))"""


JUDGED = "SELECT c.label, p.label AS prediction FROM pred p JOIN parts USING (doc_id) JOIN classes c USING (category)"


def trial_rows(trials) -> str:
    rows = ", ".join(f"({t.trial_id}, {t.min_df}, {t.lo}, {t.hi}, {t.alpha!r}::DOUBLE)" for t in trials)
    return f"trials(trial_id, min_df, lo, hi, alpha) AS (VALUES {rows})"


def searched(source: str, trials, folds) -> str:
    """Common tables up to ``results(trial_id, fold, accuracy)`` for a table with a fold column."""
    lo, hi = min(t.lo for t in trials), max(t.hi for t in trials)
    listed = ", ".join(f"({f})" for f in folds)
    return f"""fd AS (SELECT doc_id, text, category, fold FROM {source}),
{trial_rows(trials)},
vec AS (SELECT row_number() OVER (ORDER BY min_df, lo, hi) AS v, * FROM (SELECT DISTINCT min_df, lo, hi FROM trials)),
folds(f) AS (VALUES {listed}),
classes AS (SELECT f, category, row_number() OVER (PARTITION BY f ORDER BY category) AS label,
  ln(count(*) / (sum(count(*)) OVER (PARTITION BY f))) AS prior, sum(count(*)) OVER (PARTITION BY f) AS n
  FROM fd, folds WHERE fold <> f GROUP BY f, category),
termed AS ({grams(lo, hi, 'doc_id, category, fold', 'fd')}),
dfs AS (SELECT f, term, words, count(*) AS df FROM termed, folds WHERE fold <> f GROUP BY ALL),
voc AS (SELECT v, f, term, row_number() OVER () AS t, ln((1e0 + n) / (1e0 + df)) + 1 AS idf FROM dfs
  JOIN (SELECT DISTINCT f, n FROM classes) USING (f) JOIN vec ON df >= min_df AND words BETWEEN lo AND hi),
sizes AS (SELECT v, f, count(*) AS size FROM voc GROUP BY v, f),
raw AS (SELECT v, f, doc_id, category, fold, t, tf * idf AS w FROM termed JOIN voc USING (term)),
norms AS (SELECT v, f, doc_id, sqrt(sum(w * w)) AS norm, sum(w) AS mass FROM raw GROUP BY v, f, doc_id),
x AS (SELECT raw.*, w / norm AS x FROM raw JOIN norms USING (v, f, doc_id)),
lik AS (SELECT v, f, label, t, sum(x) AS s FROM x JOIN classes USING (f, category) WHERE fold <> f GROUP BY v, f, label, t),
tot AS (SELECT v, f, label, sum(s) AS total FROM lik GROUP BY v, f, label),
gains AS (SELECT trial_id, f, doc_id, label, sum(x * (ln(s + alpha) - ln(alpha))) AS gain
  FROM x JOIN lik USING (v, f, t) JOIN vec USING (v) JOIN trials USING (min_df, lo, hi) WHERE fold = f
  GROUP BY trial_id, f, doc_id, label),
tested AS (SELECT v, trial_id, alpha, fd.fold AS f, fd.doc_id, fd.category FROM fd JOIN folds ON fold = f
  CROSS JOIN trials JOIN vec USING (min_df, lo, hi)),
scored AS (SELECT trial_id, f, doc_id, td.category, c.category AS guess, label,
  c.prior + coalesce(gain, 0) + coalesce(mass / norm, 0) * (ln(alpha) - ln(total + alpha * size)) AS score
  FROM tested td JOIN classes c USING (f) JOIN tot USING (v, f, label) JOIN sizes USING (v, f)
  LEFT JOIN norms USING (v, f, doc_id) LEFT JOIN gains USING (trial_id, f, doc_id, label)),
top AS (SELECT trial_id, f, doc_id, CASE WHEN category = guess THEN 1e0 ELSE 0e0 END AS hit,
  row_number() OVER (PARTITION BY trial_id, doc_id ORDER BY round(score, 9) DESC, label) AS rn FROM scored),
results AS (SELECT trial_id, f AS fold, avg(hit) AS accuracy FROM top WHERE rn = 1 GROUP BY trial_id, f)"""


BEST = "(SELECT trial_id, round(avg(accuracy), 9) AS score FROM results GROUP BY trial_id ORDER BY score DESC, trial_id LIMIT 1)"

HISTORY = """hist AS (SELECT user_id AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
  round(avg(value), 6) AS loss FROM events GROUP BY ALL)"""
STOPS = f"""RECURSIVE {HISTORY},
ordered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM hist),
walk AS (SELECT run, i, epoch, loss AS best, 0 AS waited, CAST(NULL AS INTEGER) AS stop FROM ordered WHERE i = 1
  UNION ALL SELECT o.run, o.i, o.epoch, CASE WHEN w.best - o.loss > 0.01e0 THEN o.loss ELSE w.best END,
    CASE WHEN w.best - o.loss > 0.01e0 THEN 0 ELSE w.waited + 1 END,
    CASE WHEN w.best - o.loss <= 0.01e0 AND w.waited + 1 >= 2 THEN o.epoch END
  FROM walk w JOIN ordered o ON o.run = w.run AND o.i = w.i + 1 WHERE w.stop IS NULL),
stops AS (SELECT run, stop AS stop_epoch, best AS best_loss FROM walk
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY i DESC) = 1)"""

LOGITS = "lg AS (SELECT vec_id, label, [CAST(v AS DOUBLE) for v in embedding] AS z FROM embeddings)"
ARGMAX = "CAST(list_position(z, list_max(z)) - 1 AS INTEGER)"
LOSS = "ln(list_sum([exp(v - list_max(z)) for v in z])) - (z[label + 1] - list_max(z))"

USES = f"uses AS (SELECT token, count(*) AS n FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token)"
VOCAB = f"""{USES}, vocab AS (SELECT token, {hash_rank(42, "token")} + 3 AS id FROM uses WHERE n >= 2),
pieces AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS i FROM
  (SELECT doc_id, ({WORDS})[1:510] AS w FROM documents)),
ids AS (SELECT d.doc_id, list_concat(list_concat([2], coalesce(list(coalesce(id, 1) ORDER BY i) FILTER (i IS NOT NULL), [])), [3]) AS ids
  FROM documents d LEFT JOIN pieces p USING (doc_id) LEFT JOIN vocab USING (token) GROUP BY d.doc_id)"""


def padded(width: str, source: str) -> str:
    return f"""SELECT doc_id, md5(array_to_string(ids, ' ') || repeat(' 0', CAST({width} - len(ids) AS BIGINT))) AS ids,
  CAST(len(ids) AS BIGINT) AS used, CAST({width} AS BIGINT) AS width FROM {source}"""


SUBWORDS = r"""RECURSIVE flat AS (
  SELECT doc_id, doc_id % 7 AS batch, unnest(list_prepend('', w)) AS token, generate_subscripts(list_prepend('', w), 1) AS nr
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents)
), uses AS (
  SELECT token, count(*) AS uses FROM flat WHERE nr > 1 GROUP BY token
), spans AS (
  SELECT token AS word, i, n, CASE WHEN i > 1 THEN '##' ELSE '' END || substr(token, i, n) AS piece
  FROM (SELECT *, unnest(range(1, length(token) - i + 2)) AS n FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM uses))
), vocab AS (
  SELECT token, row_number() OVER (ORDER BY md5(token || '-42'), token) + 3 AS id FROM (
    SELECT token FROM uses WHERE uses >= 5 UNION SELECT piece FROM spans WHERE n <= 3) WHERE md5(token)[1] <> '0'
), best AS (
  SELECT word, i, max(n) AS n, arg_max(id, n) AS id FROM spans JOIN vocab ON piece = token GROUP BY word, i
), walk AS (
  SELECT token, 1 AS i, []::BIGINT[] AS ids FROM uses
  UNION ALL
  SELECT token, walk.i + n, list_append(ids, id) FROM walk JOIN best ON word = token AND best.i = walk.i
), split AS (
  SELECT token, CASE WHEN length(token) > 100 THEN [1] ELSE coalesce(any_value(ids) FILTER (i = length(token) + 1), [1]) END AS ids FROM walk GROUP BY token
), joined AS (
  SELECT doc_id, batch, coalesce(flatten(list(split.ids ORDER BY nr) FILTER (nr > 1)), []) AS ids
  FROM flat LEFT JOIN split ON flat.token = split.token GROUP BY doc_id, batch
), ids AS (
  SELECT doc_id, batch, [2] || ids[1:510] || [3] AS ids FROM joined
), wide AS (
  SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM ids
)"""

SEGMENTED = r"""RECURSIVE lexicon AS (
  SELECT token, any_value(10 + 1000 // uses) AS cost FROM (
    SELECT token, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents) GROUP BY token)
  WHERE length(token) <= 12 GROUP BY token
), flat AS (
  SELECT doc_id, unnest(list_prepend('', w)) AS token, generate_subscripts(list_prepend('', w), 1) AS nr FROM (
    SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '([^ ]+) ([^ ]+) ([^ ]+)', '\1\2\3', 'g')), '\p{L}+|\p{N}+') AS w FROM documents)
), runs AS MATERIALIZED (
  SELECT token, row_number() OVER (ORDER BY token) AS run, length(token) AS size FROM (SELECT DISTINCT token FROM flat WHERE regexp_full_match(token, '\p{L}+'))
), spans AS (
  SELECT run, i + n AS stop, n, substr(token, i + 1, n) AS piece
  FROM (SELECT *, unnest(range(1, least(12, size - i) + 1)) AS n FROM (SELECT *, unnest(range(0, size)) AS i FROM runs))
), edges AS MATERIALIZED (
  SELECT run, stop, list({'n': n, 'cost': coalesce(cost, 500)}) AS edges
  FROM spans LEFT JOIN lexicon ON piece = token WHERE n = 1 OR cost IS NOT NULL GROUP BY run, stop
), path AS (
  SELECT run, 0::BIGINT AS stop, [{'cost': 0::BIGINT, 'words': 0::BIGINT, 'back': 0::BIGINT, 'starts': []::BIGINT[]}] AS best FROM runs
  UNION ALL
  SELECT p.run, e.stop, list_prepend(list_min(list_transform(e.edges, lambda x: {'cost': p.best[x.n].cost + x.cost,
    'words': p.best[x.n].words + 1, 'back': -x.n, 'starts': list_append(p.best[x.n].starts, e.stop - x.n)})), p.best[1:11])
  FROM path p JOIN edges e ON e.run = p.run AND e.stop = p.stop + 1
), split AS (
  SELECT token, list_transform(starts, lambda b, i: substr(token, b + 1, coalesce(starts[i + 1], size) - b)) AS words
  FROM (SELECT token, size, best[1].starts AS starts FROM path JOIN runs USING (run) WHERE stop = size)
), segmented AS (
  SELECT doc_id, coalesce(flatten(list(coalesce(words, [flat.token]) ORDER BY nr) FILTER (nr > 1)), []) AS words
  FROM flat LEFT JOIN split ON flat.token = split.token GROUP BY doc_id
)"""


SHARES = """shares AS (SELECT source, lang, avg(quality) AS a, avg(toxic) AS b
  FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)"""


def epochs_sql(number: int, rate: float, decay: float) -> str:
    """Common tables of a softmax regression, epoch by epoch: ``w0`` to ``w<number>`` and the loss in each."""
    steps = [
        """x AS MATERIALIZED (SELECT vec_id, label, d, v FROM (
  SELECT vec_id, label, unnest(range(0, 65)) AS d, unnest(list_append(embedding::DOUBLE[], 1)) AS v FROM embeddings)),
w0 AS MATERIALIZED (SELECT k, d, 0e0 AS w FROM range(10) a(k), range(65) b(d))"""
    ]
    for e in range(number):
        steps.append(f"""l{e} AS MATERIALIZED (SELECT vec_id, label, k, sum(w * v) AS logit FROM x JOIN w{e} USING (d) GROUP BY ALL),
p{e} AS MATERIALIZED (SELECT vec_id, label, k, logit, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM l{e}),
g{e} AS (SELECT k, d, avg((p - CASE WHEN k = x.label THEN 1 ELSE 0 END) * v) AS g FROM x JOIN p{e} USING (vec_id) GROUP BY k, d),
w{e + 1} AS MATERIALIZED (SELECT k, d, w - {rate} * (g + CASE WHEN d < 64 THEN {decay} * w ELSE 0 END) AS w FROM w{e} JOIN g{e} USING (k, d))""")
    return "WITH " + ",\n".join(steps)


def sql() -> dict[str, str]:
    quoted = ", ".join(f"'{w}'" for w in STOPWORDS)
    table = {
        "exclude_url": "SELECT page_id, url FROM pages WHERE NOT contains(url, '/fr/')",
        "count_matching": "SELECT count(*) AS matching FROM pages WHERE contains(url, '/fr/')",
        "sanitize_filename": r"""SELECT page_id, regexp_replace(url, '[/:*?"<>|]', '_', 'g') || '.html' AS file_name FROM pages""",
        "drop_empty": f"WITH {ARTICLES} SELECT doc_id FROM art WHERE title <> '' AND content <> ''",
        "count_empty": f"WITH {ARTICLES} SELECT count(*) FILTER (title = '') AS empty_title, count(*) FILTER (content = '') AS empty_content FROM art",
        "to_documents": f"WITH {DOCS} SELECT doc_id, length(text) AS chars, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS label FROM docs",
        "union_sources": "SELECT origin, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT lang AS origin, text FROM documents UNION ALL SELECT role, text FROM conversations) GROUP BY origin",
        "strip": digest(STRIPPED.format("chr(32) || chr(12288) || chr(10) || chr(9) || text || chr(13) || chr(10) || chr(160) || chr(32) || chr(12288)")),
        "null_to_text": digest("CASE WHEN lang <> 'es' THEN text ELSE 'nan' END"),
        "fold_digits": digest("'123' || translate(text, '０１２３４５６７８９', '0123456789')"),
        "drop_symbols": digest(r"regexp_replace(text, '[^\p{L}\p{N}_\s\p{Z}]', '', 'g')"),
        "drop_digits": digest(r"regexp_replace(text, '\p{Nd}+', '', 'g')"),
        "mask_digits": digest(r"regexp_replace(text, '\p{Nd}+', '0', 'g')"),
        "drop_controls": digest("replace(replace(replace(replace(text, chr(10), ''), chr(9), ''), chr(13), ''), chr(12288), '')"),
        "token_counts": f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS tokens FROM documents",
        "ngram_counts_1_2": gram_counts(1, 2),
        "ngram_counts_1_3": gram_counts(1, 3),
        "ngram_counts_1_4": gram_counts(1, 4),
        "ngram_counts_1_8": f"SELECT docs, count(*) AS terms, CAST(sum(uses) AS BIGINT) AS uses FROM ({gram_counts(1, 8)}) GROUP BY docs",
        "term_freq": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL",
        "drop_stopwords": digest(f"array_to_string([w for w in {WORDS} if w NOT IN ({quoted})], ' ')"),
        "keep_pos": f"SELECT doc_id, md5(coalesce(array_to_string([w for w in {WORDS} if length(w) % 4 IN (0, 1)], ' '), '')) AS digest FROM documents",
        "encode_ids_max": f"WITH {VOCAB} {padded('512', 'ids')}",
        "encode_ids_longest": f"""WITH {VOCAB}, placed AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM ids),
          wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM placed) {padded('longest', 'wide')}""",
        "encode_subwords": f"WITH {SUBWORDS} {padded('longest', 'wide')}",
        "segment_words": f"WITH {SEGMENTED} SELECT doc_id, md5(array_to_string(words, ' ')) AS digest, len(words) AS words FROM segmented",
        "keep_pos_segmented": f"""WITH {SEGMENTED}, kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY nr) AS text
          FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS nr FROM segmented) JOIN lexicon ON word = token
          WHERE length(word) % 2 = 0 GROUP BY doc_id
        ) SELECT doc_id, md5(coalesce(kept.text, '')) AS digest FROM documents LEFT JOIN kept USING (doc_id)""",
        "value_counts": 'SELECT lang AS category, count(*) AS "count" FROM documents GROUP BY lang',
        "value_counts_null": """SELECT nullif(lang, 'es') AS category, count(*) AS "count" FROM documents GROUP BY 1""",
        "min_class_size": "SELECT min(n) AS min_count FROM (SELECT count(*) AS n FROM documents GROUP BY source)",
        "categories": "SELECT lang AS category, count(*) OVER () AS n_categories FROM documents GROUP BY lang",
        "shape": "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_cols FROM documents",
        "profile": " UNION ALL ".join(
            f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", '{kind}' AS dtype, count({c}) AS non_null FROM documents"""
            for i, (c, kind) in enumerate(
                [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
            )
        ),
        "head": "SELECT * FROM documents ORDER BY doc_id LIMIT 5",
        "tail_per_group": "SELECT doc_id, lang AS category FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 100",
        "balance": f"""SELECT doc_id, lang AS category FROM documents
          QUALIFY {hash_rank(42, over='PARTITION BY lang')} <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
        "split": split("0.2e0"),
        "split_tenth": split("0.1e0"),
        "split_stratified": f"WITH {PARTS} SELECT doc_id, category, part FROM parts",
        "split3": f"SELECT doc_id, part FROM ({SPLIT3})",
        "sample_fraction": f"SELECT doc_id FROM documents QUALIFY {hash_rank(369)} <= round_even(0.1e0 * count(*) OVER (), 0)",
        "remainder": f"SELECT doc_id FROM documents QUALIFY {hash_rank(369)} > round_even(0.1e0 * count(*) OVER (), 0)",
        "assign_folds": f"WITH {DOCS}, fd AS ({folded('docs')}) SELECT doc_id, category, fold FROM fd",
        "assign_folds_time": f"""WITH ev AS (SELECT event_id, event_type AS category, row_number() OVER (ORDER BY ts, event_id) AS doc_id FROM events),
          fd AS ({folded('ev')}) SELECT event_id, category AS event_type, fold FROM fd""",
        "tail_per_group_text": "SELECT doc_id, lang AS category FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR) DESC) <= 30",
        "assign_batches_shuffled": f"SELECT doc_id, ({hash_rank(42)} - 1) // 16 AS batch FROM documents",
        "assign_batches": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents",
        "label_sorted": "SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label, source FROM documents GROUP BY source",
        "label_first_seen": "SELECT CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS label, lang AS category FROM documents GROUP BY lang",
        "encode_labels": """SELECT doc_id, lang AS category, label FROM documents LEFT JOIN
          (SELECT lang AS known, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM documents WHERE lang <> 'es' GROUP BY lang) ON lang = known""",
        "assign_batches_repeated": """SELECT key, batch, count(*) AS rows FROM (
          SELECT key, (row_number() OVER (ORDER BY key NULLS FIRST) - 1) // 16 AS batch
          FROM (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id // 3 END AS key FROM documents)) GROUP BY ALL""",
        "decode_labels_unknown": """SELECT vec_id, v.label, category
          FROM (SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN label % 6 END AS label FROM embeddings) v
          LEFT JOIN (SELECT lang AS category, row_number() OVER (ORDER BY lang) - 1 AS label FROM documents GROUP BY lang) c ON c.label = v.label""",
        "train_epochs": f"""{epochs_sql(4, 2.0, 0.01)} """ + " UNION ALL ".join(
            f"SELECT {e + 1} AS epoch, avg(-ln(p)) AS loss FROM p{e} WHERE k = label" for e in range(4)),
        "epoch_logits": f"""{epochs_sql(4, 2.0, 0.01)} SELECT vec_id, k AS label, sum(w * v) AS logit FROM x JOIN w4 USING (d) GROUP BY vec_id, k""",
        "label_vocab_from": """SELECT doc_id, lang AS category, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 END AS label FROM documents""",
        "predict_text": f"""SELECT doc_id, predicted_category FROM ({whole_table_sql()})
          WHERE doc_id = (SELECT doc_id FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1)""",
        "score_table_repeated": f"""SELECT CASE WHEN doc_id % 4 <> 0 THEN doc_id % 10 END AS key, category, source, predicted_category, count(*) AS rows
          FROM ({whole_table_sql()}) GROUP BY ALL""",
        "decode_labels": """SELECT vec_id, CAST(e.label % 4 AS INTEGER) AS label, category FROM embeddings e JOIN
          (SELECT lang AS category, row_number() OVER (ORDER BY lang) - 1 AS label FROM documents GROUP BY lang) c ON c.label = e.label % 4""",
        "doc_freq_min_df": f"WITH {DOCS}, tf AS ({grams(1, 2, 'doc_id', 'docs')}) SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3",
        "tfidf": f"""WITH {DOCS}, tf AS ({grams(1, 1, 'doc_id', 'docs')}),
          terms AS (SELECT term, ln((1e0 + (SELECT count(*) FROM docs)) / (1e0 + count(*))) + 1 AS idf FROM tf GROUP BY term)
          SELECT doc_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight FROM tf JOIN terms USING (term)""",
        "nb_fit": f"""WITH {TUNED_SQL} SELECT label, term, round(s, 6) AS sum_x,
          round(ln((s + {TUNED.alpha}e0) / (t + {TUNED.alpha}e0 * (SELECT count(*) FROM terms))), 6) AS log_theta FROM lik JOIN tot USING (label)""",
        "nb_classes": f"WITH {PLAIN_SQL} SELECT label, category, n_docs AS docs, round(prior, 6) AS prior, round(t, 6) AS total FROM classes JOIN tot USING (label)",
        "nb_predict": predicted(PLAIN_SQL),
        "nb_predict_tuned": predicted(TUNED_SQL),
        "nb_predict_alpha": " UNION ALL ".join(
            f"SELECT * FROM (WITH {bayes(1, 1, 1, a)} SELECT {a}::DOUBLE AS alpha, doc_id, label, round(score, 6) AS score FROM pred)"
            for a in (0.005, 0.07, 0.09)
        ),
        "nb_metrics": f"WITH {PLAIN_SQL}, judged AS ({JUDGED}) {measured('SELECT * FROM judged')}",
        "confusion": f"WITH {PLAIN_SQL}, judged AS ({JUDGED}) SELECT label, prediction, count(*) AS n FROM judged GROUP BY label, prediction",
        "score_table": whole_table_sql(),
        "score_conversations": conversations_sql(),
        "argmax": f"WITH {LOGITS} SELECT vec_id, {ARGMAX} AS prediction FROM lg",
        "decide": f"""WITH {LOGITS} SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN {ARGMAX}
          ELSE CAST(list_sum(z) / len(z) >= 0.5e0 AS INTEGER) END AS prediction FROM lg""",
        "logit_metrics": f"WITH {LOGITS}, judged AS (SELECT label, {ARGMAX} AS prediction FROM lg) {measured('SELECT * FROM judged')}",
        "log_loss": f"WITH {LOGITS} SELECT vec_id, round({LOSS}, 6) AS loss FROM lg",
        "mean_loss": f"""WITH {LOGITS} SELECT round(avg(m), 6) AS mean_loss FROM (SELECT avg(loss) AS m FROM
          (SELECT {LOSS} AS loss, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch FROM lg) GROUP BY batch)""",
        "score_with": f"WITH {LOGITS} SELECT vec_id, {ARGMAX} AS prediction FROM lg",
        "grid_search": f"""WITH {DOCS}, fold_docs AS ({folded('docs')}), {searched('fold_docs', GRID, range(5))}
          SELECT trial_id, fold, round(accuracy, 6) AS accuracy FROM results""",
        "random_search": f"""WITH {DOCS}, fold_docs AS ({folded('docs')}), {searched('fold_docs', RANDOM, range(5))}
          SELECT trial_id, round(avg(accuracy), 6) AS accuracy FROM results GROUP BY trial_id""",
        "holdout_search": f"""WITH three AS (SELECT doc_id, text, category, CASE WHEN part = 'validation' THEN 1 ELSE 0 END AS fold
          FROM ({SPLIT3}) WHERE part <> 'test'), {searched('three', HOLDOUT, [1])}
          SELECT trial_id, round(accuracy, 6) AS accuracy FROM results""",
        "best_trial": f"""WITH {DOCS}, fold_docs AS ({folded('docs')}), {searched('fold_docs', TUNING, range(5))}
          SELECT trial_id, round(score, 6) AS score FROM {BEST}""",
        "refit": tuned_sql(),
        "train_articles": tuned_sql(parted(RECENT), "accuracy, precision, recall, f1"),
        "score_articles": scored_sql(),
        "early_stop": f"WITH {STOPS} SELECT run, stop_epoch, best_loss FROM stops",
        "best_epoch": f"WITH {HISTORY} SELECT run, epoch AS best_epoch, loss AS best_loss FROM hist QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1",
        "best_epoch_to_stop": f"""WITH {STOPS} SELECT run, epoch AS best_epoch, loss AS best_loss FROM hist JOIN stops USING (run)
          WHERE stop_epoch IS NULL OR epoch <= stop_epoch QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1""",
        "union_probability": f"WITH {SHARES} SELECT source, lang, round(a, 6) AS \"p_A\", round(b, 6) AS \"p_B\", round(a + b - a * b, 6) AS \"p_A_or_B\" FROM shares",
        "probability_pivot": f"WITH {SHARES} SELECT source, "
        + ", ".join(f"round(max(a + b - a * b) FILTER (lang = '{c}'), 6) AS {c}" for c in ("de", "en", "es", "fr"))
        + " FROM shares GROUP BY source",
    }
    for name, (sep, clean) in SEPARATORS.items():
        table[f"assemble_text_{name}"] = assembled(sep, clean)
    return table | files_sql()


def files_sql() -> dict[str, str]:
    """What comes back of articles that were written to files, and of a saved model."""
    missing = ", ".join(f"'{t}'" for t in ("", *NULL_TOKENS))
    cell = "md5(CASE WHEN {0} NOT IN (%s) THEN {0} END) AS {0}" % missing
    title, content = STRIPPED.format("title"), STRIPPED.format("content")
    line = STRIPPED.format("line")
    plain = "replace(replace(replace(replace({}, chr(10), ''), chr(9), ''), chr(13), ''), chr(12288), '')"
    body = f"array_to_string([{line} for line in string_split(content, chr(10)) if {line} <> ''], '')"
    csv = f"WITH {ARTICLES} SELECT doc_id, {cell.format('title')}, {cell.format('content')}, lang AS category FROM art JOIN documents USING (doc_id)"
    return {
        "csv_round_trip": csv,
        "csv_gzip": csv,
        "csv_first": f"SELECT * FROM ({csv}) WHERE doc_id % 8 = 0",
        "csv_split": f"SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM ({csv})",
        "zip_round_trip": csv,
        "csv_tail": "SELECT doc_id, lang AS category FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) <= 30",
        "corpus_round_trip": f"WITH {ARTICLES} SELECT 'doc_id=' || doc_id AS category, md5({title}) AS title, md5({content}) AS content FROM art",
        "corpus_body": f"WITH {ARTICLES} SELECT 'doc_id=' || doc_id AS category, md5({plain.format(body)}) AS text FROM art",
        "model_round_trip": predicted(PLAIN_SQL),
        "score_benchmark": scored_texts_sql("SELECT item_id AS id, CAST(NULL AS VARCHAR) AS role, text FROM benchmark", "id AS item_id, category AS predicted_category"),
    }


def conversations_sql() -> str:
    """Turns by role and predicted category."""
    each = scored_texts_sql("SELECT struct_pack(c := conv_id, t := turn) AS id, role, text FROM conversations", "role, category AS predicted_category")
    return f"SELECT role, predicted_category, count(*) AS turns FROM ({each}) GROUP BY ALL"


def scored_texts_sql(texts: str, columns: str) -> str:
    """Predictions for the texts of another table, by the model trained on the documents."""
    return f"""WITH {PLAIN_SQL}, turns AS ({texts}),
ctf AS ({grams(1, 1, 'id', 'turns')}),
cw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS x FROM ctf JOIN terms USING (term)),
cs AS (SELECT turns.id, role, c.label, c.category, c.prior + coalesce(sum(cw.x * (ln(coalesce(l.s, 0) + 1)
  - ln(tot.t + (SELECT count(*) FROM terms)))), 0) AS score
  FROM turns CROSS JOIN classes c JOIN tot USING (label) LEFT JOIN cw USING (id) LEFT JOIN lik l ON l.term = cw.term AND l.label = c.label
  GROUP BY turns.id, role, c.label, c.category, c.prior)
SELECT {columns} FROM cs QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, label) = 1"""


def tuned_sql(parts: str = PARTS, columns: str = "accuracy") -> str:
    """Metrics on the test part of the trial that cross-validates best on the training part."""
    models = " UNION ALL ".join(
        f"SELECT {t.trial_id} AS trial_id, * FROM (WITH {bayes(t.lo, t.hi, t.min_df, t.alpha, parts)}, judged AS ({JUDGED}) "
        f"{measured('SELECT * FROM judged', columns)})"
        for t in TUNING
    )
    return f"""WITH {parts}, train AS (SELECT doc_id, text, category FROM parts WHERE part = 'train'),
fold_docs AS ({folded('train')}), {searched('fold_docs', TUNING, range(5))}, models AS ({models})
SELECT {columns} FROM models JOIN {BEST} USING (trial_id)"""


def scored_sql() -> str:
    """Every document scored by the model trained on all of them."""
    everything = "parts AS (SELECT *, 'train' AS part FROM docs UNION ALL SELECT -1 - doc_id, text, category, source, 'test' FROM docs)"
    return f"""WITH {bayes(1, 1, 1, 1.0, f"{DOCS}, {everything}")} SELECT -1 - doc_id AS doc_id, t.category, c.category AS predicted_category
  FROM pred JOIN parts t USING (doc_id) JOIN classes c USING (label)"""


def whole_table_sql() -> str:
    """Every document scored by the model trained on the training part."""
    everything = """trained AS (SELECT * FROM parts0 WHERE part = 'train'),
parts AS (SELECT doc_id, text, category, source, part FROM trained
  UNION ALL SELECT -1 - doc_id, text, category, source, 'test' FROM docs)"""
    parts = PARTS.replace("parts AS", "parts0 AS")
    return f"""WITH {bayes(TUNED.lo, TUNED.hi, TUNED.min_df, TUNED.alpha, f"{parts}, {everything}")}
SELECT -1 - doc_id AS doc_id, t.category, t.source, c.category AS predicted_category
  FROM pred JOIN parts t USING (doc_id) JOIN classes c USING (label)"""
