import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kategora.operators import bayes, dense, features, lexicon, search
from kategora.plans.skew import lookup
from kategora.streaming.scoring import score_stream

THEMES = {
    "sports": "goal match team player coach the and of",
    "money": "market bank price stock trade the and of",
    "arts": "film music stage actor scene the and of",
}


def corpus(n=90, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(list(THEMES))
        mixed = THEMES[name].split() + rng.choice(list(THEMES.values())).split()
        rows.append((i, " ".join(rng.choices(mixed, k=rng.randint(0, 14))), name))
    return rows


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, category string").repartition(5)


def grams(text, lo, hi):
    words = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return Counter(
        " ".join(words[i : i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)
    )


class Plain:
    """The same model in plain Python, densely."""

    def __init__(self, rows, lo, hi, min_df, alpha):
        self.lo, self.hi, self.alpha = lo, hi, alpha
        seen = Counter(t for _, text, _ in rows for t in grams(text, lo, hi))
        n = len(rows)
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in seen.items() if d >= min_df}
        self.names = sorted({c for _, _, c in rows})
        counts = Counter(c for _, _, c in rows)
        self.prior = {c: math.log(counts[c] / n) for c in self.names}
        self.sums = {c: defaultdict(float) for c in self.names}
        for _, text, c in rows:
            for t, x in self.weights(text).items():
                self.sums[c][t] += x

    def weights(self, text):
        raw = {t: k * self.idf[t] for t, k in grams(text, self.lo, self.hi).items() if t in self.idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    def scores(self, text):
        x = self.weights(text)
        out = []
        for c in self.names:
            total = sum(self.sums[c].values()) + self.alpha * len(self.idf)
            out.append(self.prior[c] + sum(v * math.log((self.sums[c][t] + self.alpha) / total) for t, v in x.items()))
        return out

    def predict(self, text):
        rounded = [round(s, 9) for s in self.scores(text)]
        return rounded.index(max(rounded))


@pytest.mark.parametrize("lo, hi, min_df, alpha", [(1, 1, 1, 1.0), (1, 3, 2, 0.078), (1, 8, 1, 0.005)])
def test_model_matches_plain_python(spark, docs, lo, hi, min_df, alpha):
    train, test = docs.filter("doc_id < 70"), docs.filter("doc_id >= 70")
    model = bayes.fit(train, bayes.Settings(lo, hi, min_df, alpha))
    plain = Plain([r for r in DOCS if r[0] < 70], lo, hi, min_df, alpha)
    assert model.vocabulary == len(plain.idf)
    got = {r.doc_id: r for r in model.transform(test, "doc_id").collect()}
    assert len(got) == 20
    for i, text, _ in DOCS[70:]:
        assert got[i].label == plain.predict(text)
        assert got[i].score == pytest.approx(max(plain.scores(text)), abs=1e-9)


def test_weights_have_unit_length(docs):
    terms = features.tfidf_fit(docs)
    lengths = features.tfidf_transform(docs, terms, "doc_id").groupBy("doc_id").agg(
        F.sum(F.col("weight") ** 2).alias("q")
    )
    assert all(r.q == pytest.approx(1.0) for r in lengths.collect())


def test_save_and_load(spark, docs, tmp_path):
    model = bayes.fit(docs, bayes.Settings(1, 2, 1, 0.5))
    model.save(str(tmp_path / "model"))
    loaded = bayes.load_model(spark, str(tmp_path / "model"))
    assert loaded.settings == model.settings
    a = sorted(model.transform(docs, "doc_id").collect())
    assert a == sorted(loaded.transform(docs, "doc_id").collect())
    plain = Plain(DOCS, 1, 2, 1, 0.5)
    for sentence in ("The coach praised the team after the match", "stock prices at the bank"):
        assert loaded.predict_text(spark, sentence) == plain.names[plain.predict(sentence)]
    assert loaded.likelihood.count() == model.likelihood.count()


def test_unknown_words_give_the_prior(spark, docs):
    model = bayes.fit(docs)
    strange = spark.createDataFrame([(1, "zzz qqq"), (2, ""), (3, None)], "doc_id long, text string")
    counts = Counter(c for _, _, c in DOCS)
    best = max(sorted(counts), key=counts.get)
    for row in model.transform(strange, "doc_id").collect():
        assert sorted(counts)[row.label] == best
        assert row.score == pytest.approx(math.log(counts[best] / len(DOCS)))


def test_score_table_keeps_all_columns(docs):
    model = bayes.fit(docs)
    scored = bayes.score_table(docs.withColumn("extra", F.col("doc_id") * 2), model, "doc_id")
    assert scored.columns == ["doc_id", "text", "category", "extra", "predicted_category"]
    assert scored.count() == len(DOCS) and scored.filter("predicted_category IS NULL").count() == 0


def test_score_arriving_files(spark, docs, tmp_path):
    model = bayes.fit(docs)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, "doc_id", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.doc_id: r.predicted_category for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: r.predicted_category for r in bayes.score_table(docs, model, "doc_id").collect()}


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_keys", [2, 2_000])
def test_lookup_without_broadcast(spark, monkeypatch, how, hot_keys):
    """A key holds a third of the rows, another third has a key the table lacks."""
    monkeypatch.setattr("kategora.plans.skew.HOT_KEYS", hot_keys)
    rows = [(i, ["hot", "lost", f"k{i % 17}"][i % 3]) for i in range(900)] + [(900, None)]
    many = spark.createDataFrame(rows, "id long, term string")
    uses = Counter(t for _, t in rows if t and t != "lost")
    table = spark.createDataFrame([(t, n, n / 2) for t, n in uses.items()], "term string, df long, w double")
    plain = lookup(many, table, "term", "df", "id", how).select("id", "term", "df", "w")
    spread = lookup(many, table, "term", "df", "id", how, broadcast_bytes=0).select("id", "term", "df", "w")
    assert sorted(plain.collect(), key=str) == sorted(spread.collect(), key=str)
    assert plain.count() == (901 if how == "left" else 600)


def test_hot_rows_are_spread_by_the_shuffle(spark, capsys):
    """The salt must stay a key of the exchange, or all hot rows meet in one task."""
    rows = spark.range(100).select("id", F.lit("hot").alias("term"))
    table = spark.createDataFrame([("hot", 90), ("cold", 1)], "term string, df long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lookup(rows, table, "term", "df", "id", broadcast_bytes=0).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 2
    assert all("_key" in e and "_salt" in e for e in exchanges)


def test_large_vocabulary_path_gives_the_same_model(docs, monkeypatch):
    want = sorted(bayes.fit(docs, bayes.Settings(1, 2)).transform(docs, "doc_id").collect())
    monkeypatch.setattr("kategora.plans.skew.BROADCAST_BYTES", 0)
    got = sorted(bayes.fit(docs, bayes.Settings(1, 2)).transform(docs, "doc_id").collect())
    assert [(r.doc_id, r.label) for r in got] == [(r.doc_id, r.label) for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], abs=1e-9)


TRIALS = search.grid_trials([0.07, 1.0], [1, 2], [(1, 2), (1, 1)])


def plain_accuracy(trial, train, held):
    plain = Plain(train, trial.lo, trial.hi, trial.min_df, trial.alpha)
    return sum(plain.names[plain.predict(t)] == c for _, t, c in held) / len(held)


@pytest.mark.parametrize("per_plan", [60, 3])
def test_grid_search_matches_separate_fits(docs, monkeypatch, per_plan):
    monkeypatch.setattr(search, "TRIALS_PER_PLAN", per_plan)
    folded = docs.withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    got = {
        (r.trial_id, r.fold): r.accuracy for r in search.fold_accuracy(folded, TRIALS, range(3)).collect()
    }
    want = {
        (t.trial_id, f): plain_accuracy(t, [r for r in DOCS if r[0] % 3 != f], [r for r in DOCS if r[0] % 3 == f])
        for t in TRIALS
        for f in range(3)
    }
    assert got == pytest.approx(want)


def test_holdout_search_leaves_the_test_part_alone(docs):
    part = F.when(F.col("doc_id") < 60, "train").when(F.col("doc_id") < 75, "validation").otherwise("test")
    results = search.holdout_search(docs.withColumn("part", part), TRIALS)
    got = {r.trial_id: r.accuracy for r in results.collect()}
    want = {t.trial_id: plain_accuracy(t, DOCS[:60], DOCS[60:75]) for t in TRIALS}
    assert got == pytest.approx(want)
    best = search.best_trial(results).first().trial_id
    assert best == max(want, key=lambda i: (round(want[i], 9), -i))


def test_random_trials_are_seeded_and_in_range():
    space = ([1, 2, 3], [(1, 1), (1, 2), (1, 3)], (1e-2, 1e2))
    trials = search.random_trials(200, *space, seed=1)
    assert trials == search.random_trials(200, *space, seed=1)
    assert trials != search.random_trials(200, *space, seed=2)
    assert all(1e-2 <= t.alpha <= 1e2 for t in trials)
    assert {t.min_df for t in trials} == {1, 2, 3} and {t.hi for t in trials} == {1, 2, 3}
    assert 60 < sum(t.alpha < 1 for t in trials) < 140


def test_grid_order():
    trials = search.grid_trials([0.078, 0.07], [1], [(1, 3), (1, 2)])
    assert [(t.alpha, t.hi) for t in trials] == [(0.078, 3), (0.078, 2), (0.07, 3), (0.07, 2)]


def test_keep_pos(spark):
    texts = [(1, "大きい 犬が 走る 大きい"), (2, "走る"), (3, "見知らぬ 犬が"), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = [("大きい", "ADJ", 2), ("犬が", "NOUN", 2), ("走る", "VERB", 2)]
    kept = lexicon.keep_pos(df, spark.createDataFrame(words, "token string, pos string, uses long"))
    assert dict(kept.collect()) == {1: "大きい 犬が 大きい", 2: "", 3: "犬が", 4: ""}


def test_keep_pos_by_outside_analyser(spark):
    analyse = lambda t: [(w, "NOUN" if w.istitle() else "VERB") for w in t.split()]
    df = spark.createDataFrame([("Cats run Home",), (None,)], "text string")
    got = [r[0] for r in df.select(lexicon.keep_pos_by(analyse)(F.col("text"))).collect()]
    assert got == ["Cats Home", None]


def test_encode_ids(spark):
    df = spark.createDataFrame(
        [(1, "aa bb zz aa", 0), (2, "bb", 0), (3, "", 1), (4, "aa bb aa bb aa bb", 1)], "doc_id long, text string, batch int"
    )
    vocab = spark.createDataFrame([("aa", 7, 5), ("bb", 8, 5)], "token string, id int, uses long")
    special = {"PAD": 0, "UNK": 1, "CLS": 2, "SEP": 3}
    long = {r.doc_id: r for r in lexicon.encode_ids(df, vocab, special, 5, "max").collect()}
    assert long[1].input_ids == [2, 7, 8, 1, 3] and long[1].attention_mask == [1] * 5
    assert long[2].input_ids == [2, 8, 3, 0, 0] and long[2].attention_mask == [1, 1, 1, 0, 0]
    assert long[3].input_ids == [2, 3, 0, 0, 0]
    short = {r.doc_id: r for r in lexicon.encode_ids(df, vocab, special, 6, "longest", "batch").collect()}
    assert [len(short[i].input_ids) for i in (1, 2, 3, 4)] == [6, 6, 6, 6]
    small = df.filter("doc_id in (2, 3)")
    free = {r.doc_id: r.input_ids for r in lexicon.encode_ids(small, vocab, special).collect()}
    assert free == {2: [2, 8, 3], 3: [2, 3, 0]}


def test_dense_classifier(spark):
    rng = random.Random(0)
    points = []
    for i in range(90):
        c = i % 3
        points.append((i, [rng.gauss(4.0 * (c == j), 1.0) for j in range(3)], c))
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>, label int")
    model = dense.fit_dense(df)
    scored = dense.dense_logits(df, model)
    assert scored.filter("label = prediction").count() >= 85
    part = F.when(F.col("vec_id") < 60, "train").otherwise("validation")
    losses = dense.dense_search(df.withColumn("part", part), [0.0, 10.0])
    assert search.best_trial(losses, "loss", "min").first().trial_id == 0
    outside = dense.score_with(df, lambda: (lambda batch: batch), "embedding", 3, "guess")
    assert outside.filter("guess = label").count() >= 80


def test_too_many_classes_are_refused(spark):
    df = spark.range(1_001).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("category"))
    with pytest.raises(ValueError, match="1001 classes"):
        bayes.fit(df)
