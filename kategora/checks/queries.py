"""Queries over the shared test tables, one or more for every operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kategora.checks import files
from kategora.checks.tables import articles, documents, history, load, logits
from kategora.functions import scores, text
from kategora.operators import (
    bayes,
    dense,
    epochs,
    features,
    inspect,
    labels,
    lexicon,
    metrics,
    prepare,
    probability,
    sampling,
    search,
    segmentation,
    subwords,
    training,
)
from kategora.operators import grams as grams_of
from kategora.operators import history as runs
from kategora.plans.ordering import hash_order, positions
from kategora.plans.storage import shared_dir, staged

Query = Callable[[SparkSession, str], DataFrame]

NEEDLE = "/fr/"
SEPARATORS = {"space": (" ", "none"), "stop": ("。", "parts"), "stop_space": ("。 ", "none"), "dot": (". ", "parts"), "whole": ("。", "whole")}
STOPWORDS = ["the", "and", "que", "der", "les"]
SPECIAL = {"PAD": 0, "UNK": 1, "CLS": 2, "SEP": 3}
GRID = search.grid_trials([0.078, 0.07, 0.09], [1], [(1, 3), (1, 2)])
TUNING = search.grid_trials([0.078, 0.07, 0.09], [1, 2], [(1, 1)])
RANDOM = search.random_trials(50, [1, 2, 3], [(1, 1), (1, 2), (1, 3)], (1e-2, 1e2), seed=7)
HOLDOUT = search.random_trials(50, [1, 2, 3, 4, 5], [(1, 1), (1, 2), (1, 3)], (1e-2, 1e2), seed=11)
TUNED = bayes.Settings(lo=1, hi=2, alpha=0.078)


def hashed(transform: Callable[[Column], Column], before: str = "", after: str = "") -> Query:
    """Digest of every document after a text function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        whole = F.concat(F.lit(before), F.col("text"), F.lit(after))
        return documents(spark, folder).select("doc_id", F.md5(transform(whole)).alias("digest"))

    return run


def assembled(sep: str, clean: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        joined = prepare.assemble_text(articles(spark, folder), sep, clean)
        return joined.select("doc_id", F.md5("text").alias("digest"))

    return run


def grams(lo: int, hi: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return grams_of.gram_counts(documents(spark, folder), "text", lo, hi)

    return run


def gram_histogram(lo: int, hi: int) -> Query:
    """How many n-grams are found in how many documents, and how often."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return grams_of.gram_histogram(documents(spark, folder), "text", lo, hi)

    return run


def missing_texts(spark, folder):
    some = F.when(F.col("category") != "es", F.col("text"))
    return documents(spark, folder).select("doc_id", F.md5(text.null_to_text(some)).alias("digest"))


def url_rows(spark, folder):
    return prepare.exclude_url(load(spark, folder, "pages"), NEEDLE).select("page_id", "url")


def url_matches(spark, folder):
    return prepare.count_matching(load(spark, folder, "pages"), NEEDLE)


def file_names(spark, folder):
    return load(spark, folder, "pages").select(
        "page_id", text.sanitize_filename(F.col("url")).alias("file_name")
    )


def non_empty(spark, folder):
    return prepare.drop_empty(articles(spark, folder)).select("doc_id")


def empty_counts(spark, folder):
    return inspect.count_empty(articles(spark, folder))


def training_columns(spark, folder):
    docs = documents(spark, folder)
    coded = labels.encode_labels(docs, labels.label_vocab(docs))
    pruned = prepare.to_documents(coded, keep=["doc_id"])
    return pruned.select("doc_id", F.length("text").cast("long").alias("chars"), "label")


def all_texts(spark, folder):
    docs = documents(spark, folder).select(F.col("category").alias("origin"), "text")
    turns = load(spark, folder, "conversations").select(F.col("role").alias("origin"), "text")
    both = prepare.union_sources([docs, turns])
    return both.groupBy("origin").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars")
    )


def token_counts(spark, folder):
    words = F.size(text.tokens(F.col("text"))).cast("long")
    return documents(spark, folder).select("doc_id", words.alias("tokens"))


def term_frequency(spark, folder):
    tf = features.term_freq(documents(spark, folder), ["doc_id"])
    return tf.select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def stopword_removed(spark, folder):
    kept = text.drop_stopwords(text.tokens(F.col("text")), STOPWORDS)
    return documents(spark, folder).select("doc_id", F.md5(F.array_join(kept, " ")).alias("digest"))


def nouns_and_adjectives(spark, folder):
    docs = documents(spark, folder)
    sort = F.length("token") % 4
    pos = F.when(sort == 0, "NOUN").when(sort == 1, "ADJ").when(sort == 2, "VERB").otherwise("PART")
    tagged = lexicon.token_uses(docs).withColumn("pos", pos)
    kept = lexicon.keep_pos(docs, tagged)
    return kept.select("doc_id", F.md5("kept_text").alias("digest"))


def _vocabulary(docs: DataFrame) -> DataFrame:
    known = staged(lexicon.token_uses(docs).filter(F.col("uses") >= 2), "known")
    placed = positions(known, hash_order("token", 42), "place")
    return placed.select("token", "uses", (F.col("place") + 3).cast("int").alias("id"))


def _joined(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.md5(F.array_join("input_ids", " ")).alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda acc, m: acc + m).cast("long").alias("used"),
        F.size("input_ids").cast("long").alias("width"),
    )


def encoded_to_limit(spark, folder):
    docs = documents(spark, folder)
    return _joined(lexicon.encode_ids(docs, _vocabulary(docs), SPECIAL, 512, "max"))


def encoded_to_longest(spark, folder):
    docs = documents(spark, folder)
    batched = sampling.assign_batches(docs, 100, "doc_id")
    return _joined(lexicon.encode_ids(batched, _vocabulary(docs), SPECIAL, 512, "longest", "batch"))


def _pieces(docs: DataFrame) -> DataFrame:
    """Sub-words of the corpus: frequent words, beginnings, and inner parts of words; a sixteenth is left out."""
    uses = subwords.word_uses(docs)
    size = F.char_length("token")
    begin = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(3))), lambda n: F.substring("token", F.lit(1), n))
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda at: F.transform(
                F.sequence(F.lit(1), F.least(size - at, F.lit(3))),
                lambda n: F.concat(F.lit("##"), F.substring("token", at + 1, n)),
            ),
        )
    )
    parts = uses.select(F.explode(F.when(size > 1, F.concat(begin, inner)).otherwise(begin)).alias("token"))
    found = uses.filter("uses >= 5").select("token").unionByName(parts).distinct().filter(~F.md5("token").startswith("0"))
    placed = positions(found, hash_order("token", 42), "place")
    return staged(placed.select("token", (F.col("place") + 3).cast("int").alias("id")), "vocabulary")


def sub_words(spark, folder):
    """Sub-word ids of every document, in batches that are padded to their longest row."""
    docs = documents(spark, folder).withColumn("batch", (F.col("doc_id") % 7).cast("int"))
    return _joined(subwords.encode_subwords(docs, _pieces(docs), SPECIAL, 512, "longest", "batch"))


def _glued(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose words are written together by threes, and a lexicon with costs."""
    docs = documents(spark, folder)
    words = lexicon.token_uses(docs).filter(F.char_length("token") <= 12)
    cost = 10 + F.call_function("div", F.lit(1000), F.col("uses"))
    pos = F.when(F.char_length("token") % 2 == 0, "NOUN").otherwise("VERB")
    glued = docs.withColumn("text", F.regexp_replace("text", "([^ ]+) ([^ ]+) ([^ ]+)", "$1$2$3"))
    return glued, words.select("token", "uses", cost.alias("cost"), pos.alias("pos"))


def segmented_words(spark, folder):
    docs, words = _glued(spark, folder)
    found = segmentation.segment_words(docs, words, runs=r"\p{L}+", words=r"\p{N}+", unknown_cost=500)
    return found.select("doc_id", F.md5(F.array_join("words", " ")).alias("digest"), F.size("words").cast("long").alias("words"))


def segmented_nouns(spark, folder):
    docs, words = _glued(spark, folder)
    found = segmentation.segment_words(docs, words, runs=r"\p{L}+", words=r"\p{N}+", unknown_cost=500)
    kept = lexicon.keep_pos(found, words, text="words", words=lambda c: c)
    return kept.select("doc_id", F.md5("kept_text").alias("digest"))


def class_counts(spark, folder):
    return inspect.value_counts(documents(spark, folder), "category")


def class_counts_with_null(spark, folder):
    docs = documents(spark, folder)
    some = docs.withColumn("category", F.when(F.col("category") != "es", F.col("category")))
    return inspect.value_counts(some, "category", dropna=False)


def smallest_class(spark, folder):
    return inspect.min_class_size(documents(spark, folder), "source")


def category_list(spark, folder):
    return inspect.categories(documents(spark, folder))


def table_shape(spark, folder):
    return inspect.shape(load(spark, folder, "documents"))


def table_profile(spark, folder):
    return inspect.profile(load(spark, folder, "documents"))


def first_rows(spark, folder):
    return inspect.head(load(spark, folder, "documents"), 5, "doc_id")


def tail_of_class(spark, folder):
    return sampling.tail_per_group(documents(spark, folder), "category", 100, "doc_id").select("doc_id", "category")


def balanced(spark, folder):
    return sampling.balance(documents(spark, folder), "category", "doc_id").select("doc_id", "category")


def split_plain(spark, folder):
    return sampling.split(documents(spark, folder), "doc_id", 0.2).select("doc_id", "part")


def split_tenth(spark, folder):
    return sampling.split(documents(spark, folder), "doc_id", 0.1).select("doc_id", "part")


def split_stratified(spark, folder):
    parts = sampling.split(documents(spark, folder), "doc_id", 0.2, stratify="category")
    return parts.select("doc_id", "category", "part")


def split_three(spark, folder):
    return sampling.split3(documents(spark, folder), "doc_id").select("doc_id", "part")


def sampled(spark, folder):
    return sampling.sample_fraction(documents(spark, folder), 0.1, "doc_id").select("doc_id")


def not_sampled(spark, folder):
    docs = documents(spark, folder)
    drawn = sampling.sample_fraction(docs, 0.1, "doc_id")
    return sampling.remainder(docs, drawn, "doc_id").select("doc_id")


def folds(spark, folder):
    return sampling.assign_folds(documents(spark, folder), 5, "category", "doc_id").select("doc_id", "category", "fold")


def batches_shuffled(spark, folder):
    return sampling.assign_batches(documents(spark, folder), 16, "doc_id", shuffle=True).select("doc_id", "batch")


def tail_by_text(spark, folder):
    """The last rows of each class in the order of a text, here a digest."""
    docs = documents(spark, folder).withColumn("digest", F.md5(F.col("doc_id").cast("string")))
    return sampling.tail_per_group(docs, "category", 30, "digest").select("doc_id", "category")


def folds_by_time(spark, folder):
    """Folds in the order of a timestamp."""
    events = load(spark, folder, "events").withColumn("at", F.struct("ts", "event_id"))
    return sampling.assign_folds(events, 5, "event_type", "at").select("event_id", "event_type", "fold")


def batches_repeated(spark, folder):
    """Keys that several rows share, and NULL keys: every row gets one batch."""
    key = F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("doc_id") / 3)).alias("key")
    rows = documents(spark, folder).select(key, "text")
    return sampling.assign_batches(rows, 16, "key").groupBy("key", "batch").agg(F.count(F.lit(1)).alias("rows"))


def batches_ordered(spark, folder):
    return sampling.assign_batches(documents(spark, folder), 16, "doc_id").select("doc_id", "batch")


def labels_sorted(spark, folder):
    return labels.label_vocab(documents(spark, folder), "source").withColumnRenamed("category", "source")


def labels_first_seen(spark, folder):
    return labels.label_vocab(documents(spark, folder), order="first_seen", order_col="doc_id")


def labels_encoded(spark, folder):
    docs = documents(spark, folder)
    known = labels.label_vocab(docs.filter(F.col("category") != "es"))
    return labels.encode_labels(docs, known).select("doc_id", "category", "label")


def labels_listed(spark, folder):
    """Classes numbered by a given list of names; documents of other classes have no number."""
    docs = documents(spark, folder)
    return labels.encode_labels(docs, labels.label_vocab_from(spark, ["fr", "de", "xx"])).select("doc_id", "category", "label")


def labels_unknown(spark, folder):
    """Class numbers that the vocabulary does not have, and NULL, stay rows."""
    number = F.when(F.col("vec_id") % 5 != 0, F.col("label") % 6)
    vectors = load(spark, folder, "embeddings").select("vec_id", number.alias("label"))
    return labels.decode_labels(vectors, labels.label_vocab(documents(spark, folder)))


def labels_decoded(spark, folder):
    vectors = load(spark, folder, "embeddings").select("vec_id", (F.col("label") % 4).alias("label"))
    return labels.decode_labels(vectors, labels.label_vocab(documents(spark, folder)))


def document_frequency(spark, folder):
    return features.doc_freq(features.term_freq(documents(spark, folder), [], lo=1, hi=2), 3)


def tfidf_weights(spark, folder):
    docs = documents(spark, folder)
    terms = features.tfidf_fit(docs)
    weights = features.tfidf_transform(docs, terms, "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    parts = sampling.split(documents(spark, folder), "doc_id", 0.2, stratify="category")
    return parts.filter("part = 'train'"), parts.filter("part = 'test'")


def nb_likelihood(spark, folder):
    train, _ = _parts(spark, folder)
    return bayes.fit(train, TUNED).likelihood.select(
        "label", "term", F.round("sum_x", 6).alias("sum_x"), F.round("log_theta", 6).alias("log_theta")
    )


def nb_classes(spark, folder):
    train, _ = _parts(spark, folder)
    return bayes.fit(train).classes.select(
        "label", "category", "docs", F.round("prior", 6).alias("prior"), F.round("total", 6).alias("total")
    )


def nb_predictions(spark, folder, settings=bayes.Settings()):
    train, test = _parts(spark, folder)
    model = bayes.fit(train, settings)
    return model.transform(test, "doc_id").select("doc_id", "label", F.round("score", 6).alias("score"))


def nb_predictions_tuned(spark, folder):
    return nb_predictions(spark, folder, TUNED)


def nb_alphas(spark, folder):
    """One training, three smoothing values."""
    train, test = _parts(spark, folder)
    model = bayes.fit(train)
    shown = [
        model.with_alpha(a).transform(test, "doc_id").select(
            F.lit(a).alias("alpha"), "doc_id", "label", F.round("score", 6).alias("score")
        )
        for a in (0.005, 0.07, 0.09)
    ]
    return prepare.union_sources(shown)


def _judged(spark, folder) -> DataFrame:
    train, test = _parts(spark, folder)
    model = bayes.fit(train)
    guessed = model.transform(test, "doc_id").select("doc_id", F.col("label").alias("prediction"))
    truth = labels.encode_labels(test.select("doc_id", "category"), model.classes)
    return truth.join(guessed, "doc_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def nb_metrics(spark, folder):
    return _rounded(metrics.metrics(_judged(spark, folder)))


def nb_confusion(spark, folder):
    return metrics.confusion(_judged(spark, folder))


def scored_table(spark, folder):
    """Every document, those of the training part too, with the category that the model predicts."""
    train, _ = _parts(spark, folder)
    model = bayes.fit(train, TUNED)
    return bayes.score_table(documents(spark, folder), model, "doc_id").select("doc_id", "category", "source", "predicted_category")


def text_predicted(spark, folder):
    """The category of one text, the longest of the table (the first of several)."""
    docs = documents(spark, folder)
    train, _ = _parts(spark, folder)
    longest = docs.orderBy(F.desc(F.length("text")), "doc_id").first()
    category = bayes.fit(train, TUNED).predict_text(spark, longest["text"])
    return docs.filter(F.col("doc_id") == longest["doc_id"]).select("doc_id", F.lit(category).alias("predicted_category"))


def scored_repeated(spark, folder):
    """The same with a key that several documents share or that is NULL."""
    train, _ = _parts(spark, folder)
    rows = documents(spark, folder).withColumn("key", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 10))
    scored = bayes.score_table(rows.select("key", "text", "category", "source"), bayes.fit(train, TUNED), "key")
    return scored.groupBy("key", "category", "source", "predicted_category").agg(F.count(F.lit(1)).alias("rows"))


def scored_conversations(spark, folder):
    """Categories predicted for texts that were never labelled."""
    train, _ = _parts(spark, folder)
    turns = load(spark, folder, "conversations").withColumn("turn_id", F.struct("conv_id", "turn"))
    scored = bayes.score_table(turns, bayes.fit(train), "turn_id")
    return scored.groupBy("role", "predicted_category").agg(F.count(F.lit(1)).alias("turns"))


def _trained_epochs(spark, folder) -> epochs.SoftmaxModel:
    """Four epochs, with a stop after the second: saved, loaded and trained on."""
    vectors = load(spark, folder, "embeddings")
    half = epochs.train_epochs(vectors, 10, 64, 2, rate=2.0, decay=0.01)
    path = f"{shared_dir(spark)}/softmax-{uuid.uuid4().hex}"
    half.save(spark, path)
    return epochs.train_epochs(vectors, 10, 64, 2, rate=2.0, decay=0.01, start=epochs.load_softmax(spark, path))


def epoch_losses(spark, folder):
    return _trained_epochs(spark, folder).history(spark).select("epoch", "loss")


def epoch_logits(spark, folder):
    scored = _trained_epochs(spark, folder).transform(load(spark, folder, "embeddings"))
    return scored.select("vec_id", F.posexplode("logits").alias("label", "logit"))


def best_class(spark, folder):
    return logits(spark, folder).select("vec_id", scores.argmax(F.col("logits")).alias("prediction"))


def threshold_class(spark, folder):
    """Odd vectors have a score per class, even ones a single score: the mean of the vector."""
    mean = F.aggregate("logits", F.lit(0.0), lambda a, v: a + v) / F.size("logits")
    single = F.when(F.col("vec_id") % 2 == 1, F.col("logits").cast("array<double>")).otherwise(F.array(mean))
    return logits(spark, folder).select("vec_id", scores.decide(single).alias("prediction"))


def logit_metrics(spark, folder):
    judged = logits(spark, folder).withColumn("prediction", scores.argmax(F.col("logits")))
    return _rounded(metrics.metrics(judged))


def logit_losses(spark, folder):
    lossy = metrics.log_loss(logits(spark, folder), "logits", "label")
    return lossy.select("vec_id", F.round("loss", 6).alias("loss"))


def batch_loss(spark, folder):
    batched = sampling.assign_batches(logits(spark, folder), 16, "vec_id")
    return _rounded(metrics.mean_loss(metrics.log_loss(batched, "logits", "label")))


def outside_model(spark, folder):
    def load_model():
        return lambda batch: batch

    vectors = load(spark, folder, "embeddings").select("vec_id", "embedding")
    return dense.score_with(vectors, load_model, "embedding", 64).select("vec_id", "prediction")


def dense_classifier(spark, folder):
    vectors = load(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    model = dense.fit_dense(vectors)
    return dense.dense_logits(vectors, model).select("vec_id", "label", "prediction")


def dense_search(spark, folder):
    vectors = load(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    parts = sampling.split3(vectors, "vec_id")
    results = dense.dense_search(parts, [0.0, 0.01, 0.1])
    return search.best_trial(results, "loss", "min")


def _results(results: DataFrame) -> DataFrame:
    return results.withColumn("accuracy", F.round("accuracy", 6))


def grid_search(spark, folder):
    return _results(search.grid_search(documents(spark, folder), GRID))


def random_search(spark, folder):
    found = search.grid_search(documents(spark, folder), RANDOM)
    return found.groupBy("trial_id").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))


def holdout_search(spark, folder):
    return _results(search.holdout_search(sampling.split3(documents(spark, folder), "doc_id"), HOLDOUT))


def best_trial(spark, folder):
    found = search.best_trial(search.grid_search(documents(spark, folder), TUNING))
    return found.withColumn("score", F.round("score", 6))


def tuned_accuracy(spark, folder):
    """Search on the training part, train again with the best trial, judge on the test part."""
    train, test = _parts(spark, folder)
    best = search.best_trial(search.grid_search(train, TUNING)).first().trial_id
    model = bayes.refit(train, next(t for t in TUNING if t.trial_id == best))
    truth = labels.encode_labels(test.select("doc_id", "category"), model.classes)
    guessed = model.transform(test, "doc_id").select("doc_id", F.col("label").alias("prediction"))
    return _rounded(metrics.metrics(truth.join(guessed, "doc_id")).select("accuracy"))


def trained_on_articles(spark, folder):
    """The whole way from titles and contents to the metrics of the chosen model."""
    recent = training.prepare_articles(articles(spark, folder), "doc_id", None, 400)
    return _rounded(training.train_articles(recent, TUNING, "doc_id", "。", "parts").metrics)


def scored_articles(spark, folder):
    """Articles scored with the separator and cleaning their model was trained with."""
    rows = articles(spark, folder)
    settings = bayes.Settings(sep="。", clean="parts")
    model = bayes.fit(prepare.assemble_text(rows, settings.sep, settings.clean), settings)
    return training.score_articles(rows, model, "doc_id").select("doc_id", "category", "predicted_category")


def stop_epochs(spark, folder):
    return runs.early_stop(history(spark, folder), 2, 0.01)


def best_epochs(spark, folder):
    return runs.best_epoch(history(spark, folder))


def best_epochs_to_stop(spark, folder):
    losses = history(spark, folder)
    return runs.best_epoch(losses, runs.early_stop(losses, 2, 0.01))


def _shares(spark, folder) -> DataFrame:
    """Share of good and of toxic documents per source and language."""
    marks = load(spark, folder, "labels")
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source")
    return docs.join(marks, "doc_id").groupBy("source", "lang").agg(
        F.avg("quality").alias("p_A"), F.avg("toxic").alias("p_B")
    )


def union_probability(spark, folder):
    both = probability.with_union(_shares(spark, folder))
    return both.select("source", "lang", *[F.round(c, 6).alias(c) for c in ("p_A", "p_B", "p_A_or_B")])


def probability_pivot(spark, folder):
    both = probability.with_union(_shares(spark, folder))
    wide = inspect.pivot(both, "source", "lang", "p_A_or_B")
    return wide.select("source", *[F.round(c, 6).alias(c) for c in wide.columns if c != "source"])


def registered() -> dict[str, Query]:
    table: dict[str, Query] = {
        "exclude_url": url_rows,
        "count_matching": url_matches,
        "sanitize_filename": file_names,
        "drop_empty": non_empty,
        "count_empty": empty_counts,
        "to_documents": training_columns,
        "union_sources": all_texts,
        "strip": hashed(text.strip, " \u3000\n\t", "\r\n\u00a0 \u3000"),
        "null_to_text": missing_texts,
        "fold_digits": hashed(text.fold_digits, "１２３"),
        "drop_symbols": hashed(text.drop_symbols),
        "drop_digits": hashed(text.drop_digits),
        "mask_digits": hashed(text.mask_digits),
        "drop_controls": hashed(text.drop_controls),
        "token_counts": token_counts,
        "ngram_counts_1_2": grams(1, 2),
        "ngram_counts_1_3": grams(1, 3),
        "ngram_counts_1_4": grams(1, 4),
        "ngram_counts_1_8": gram_histogram(1, 8),
        "term_freq": term_frequency,
        "drop_stopwords": stopword_removed,
        "keep_pos": nouns_and_adjectives,
        "encode_ids_max": encoded_to_limit,
        "encode_ids_longest": encoded_to_longest,
        "encode_subwords": sub_words,
        "segment_words": segmented_words,
        "keep_pos_segmented": segmented_nouns,
        "value_counts": class_counts,
        "value_counts_null": class_counts_with_null,
        "min_class_size": smallest_class,
        "categories": category_list,
        "shape": table_shape,
        "profile": table_profile,
        "head": first_rows,
        "tail_per_group": tail_of_class,
        "tail_per_group_text": tail_by_text,
        "assign_folds_time": folds_by_time,
        "balance": balanced,
        "split": split_plain,
        "split_tenth": split_tenth,
        "split_stratified": split_stratified,
        "split3": split_three,
        "sample_fraction": sampled,
        "remainder": not_sampled,
        "assign_folds": folds,
        "assign_batches_shuffled": batches_shuffled,
        "assign_batches": batches_ordered,
        "assign_batches_repeated": batches_repeated,
        "label_sorted": labels_sorted,
        "label_first_seen": labels_first_seen,
        "encode_labels": labels_encoded,
        "decode_labels": labels_decoded,
        "label_vocab_from": labels_listed,
        "decode_labels_unknown": labels_unknown,
        "doc_freq_min_df": document_frequency,
        "tfidf": tfidf_weights,
        "nb_fit": nb_likelihood,
        "nb_classes": nb_classes,
        "nb_predict": nb_predictions,
        "nb_predict_tuned": nb_predictions_tuned,
        "nb_predict_alpha": nb_alphas,
        "nb_metrics": nb_metrics,
        "confusion": nb_confusion,
        "score_table": scored_table,
        "train_epochs": epoch_losses,
        "epoch_logits": epoch_logits,
        "predict_text": text_predicted,
        "score_table_repeated": scored_repeated,
        "score_conversations": scored_conversations,
        "argmax": best_class,
        "decide": threshold_class,
        "logit_metrics": logit_metrics,
        "log_loss": logit_losses,
        "mean_loss": batch_loss,
        "score_with": outside_model,
        "fit_dense": dense_classifier,
        "dense_search": dense_search,
        "grid_search": grid_search,
        "random_search": random_search,
        "holdout_search": holdout_search,
        "best_trial": best_trial,
        "refit": tuned_accuracy,
        "train_articles": trained_on_articles,
        "score_articles": scored_articles,
        "early_stop": stop_epochs,
        "best_epoch": best_epochs,
        "best_epoch_to_stop": best_epochs_to_stop,
        "union_probability": union_probability,
        "probability_pivot": probability_pivot,
    }
    for name, (sep, clean) in SEPARATORS.items():
        table[f"assemble_text_{name}"] = assembled(sep, clean)
    return table | files.registered()
