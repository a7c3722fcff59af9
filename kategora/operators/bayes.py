"""Multinomial naive Bayes over TF-IDF weights, trained and applied with joins and sums."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kategora.operators.features import smooth_idf, term_freq, tfidf_norms
from kategora.operators.labels import decode_labels, encode_labels
from kategora.operators.postings import class_shares, doc_terms, unnested
from kategora.plans.skew import Measure, lookup, measure, measuring
from kategora.plans.storage import discard, pinned, staged

# Scores are compared after rounding: the order of a distributed sum must not decide a tie.
SCORE_DIGITS = 9
# Every class is a column of the sums; more of them than this are refused.
MAX_CLASSES = 1_000


@dataclass(frozen=True)
class Settings:
    """What a text classifier is made of; saved with the model."""

    lo: int = 1
    hi: int = 1
    min_df: int = 1
    alpha: float = 1.0
    sep: str = " "
    clean: str = "none"


def nb_priors(df: DataFrame, category: str = "category") -> DataFrame:
    """``(label, category, docs, prior)`` with labels by sorted name and unsmoothed log priors."""
    counts = (
        df.filter(F.col(category).isNotNull())
        .groupBy(F.col(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("docs"))
    )
    # Windows over one row per class.
    number = F.row_number().over(Window.orderBy("category")) - 1
    total = F.sum("docs").over(Window.partitionBy())
    return counts.select(
        number.cast("int").alias("label"), "category", "docs", F.log(F.col("docs") / total).alias("prior")
    )


@dataclass(frozen=True)
class TextModel:
    """A trained model: tables ``terms(term, df, idf, sums)`` and ``classes(label, category,
    docs, prior, total)``, the vocabulary size and the settings. ``sums`` has an entry per class.
    """

    terms: DataFrame
    classes: DataFrame
    vocabulary: int
    settings: Settings
    size: Measure

    @property
    def likelihood(self) -> DataFrame:
        """Smoothed log likelihoods ``(label, term, sum_x, log_theta)`` of seen class-term pairs."""
        seen = self.terms.select("term", F.posexplode("sums").alias("label", "sum_x"))
        seen = seen.filter(F.col("sum_x") > 0).join(pinned(self.classes.select("label", "total")), "label")
        mass = F.col("total") + F.lit(self.settings.alpha * self.vocabulary)
        return seen.select(
            "label",
            "term",
            "sum_x",
            F.log((F.col("sum_x") + F.lit(self.settings.alpha)) / mass).alias("log_theta"),
        )

    def with_alpha(self, alpha: float) -> TextModel:
        """The same counts with another smoothing; nothing is trained again."""
        return replace(self, settings=replace(self.settings, alpha=alpha))

    def transform(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """Best class of each document: ``(key, label, score)``.

        One lookup of the terms and one sum per document: its length and its inner products with
        all classes come out of the same aggregation. Documents without known terms get the prior.
        """
        s = self.settings
        classes = self.classes.orderBy("label").select("prior", "total").collect()
        table = self.terms.select(
            "term", "df", "idf", F.transform("sums", lambda v: F.log(v + F.lit(s.alpha))).alias("logs")
        )
        terms = doc_terms(df, [key], text, s.lo, s.hi, outer=True)
        hits = unnested(lookup(terms, table, "term", "df", key, "left", self.size), [key, "tf"])
        hits = hits.withColumn("raw", F.col("tf") * F.col("idf"))
        sums = hits.groupBy(key).agg(
            F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
            F.sum("raw").alias("mass"),
            *[
                F.sum(F.col("raw") * F.get("logs", F.lit(c))).alias(f"dot{c}")
                for c in range(len(classes))
            ],
        )
        scores = [
            F.lit(row.prior)
            + F.coalesce(
                (F.col(f"dot{c}") - F.col("mass") * F.log(F.lit(row.total + s.alpha * self.vocabulary)))
                / F.col("norm"),
                F.lit(0.0),
            )
            for c, row in enumerate(classes)
        ]
        # Greatest rounded score, then the lowest label; the score itself is handed on as it is.
        ranked = [
            F.struct(F.round(v, SCORE_DIGITS), F.lit(-c).alias("at"), v.alias("score"))
            for c, v in enumerate(scores)
        ]
        return sums.select(key, F.array_max(F.array(*ranked)).alias("_best")).select(
            key, (-F.col("_best.at")).cast("int").alias("label"), F.col("_best.score").alias("score")
        )

    def predict_text(self, spark: SparkSession, text: str) -> str:
        """Category of one given text."""
        one = spark.createDataFrame([(0, text)], "doc_id long, text string")
        # The model is read once, for the terms of the one text; only they are looked up.
        known = term_freq(one, [], "text", self.settings.lo, self.settings.hi).select("term")
        found = staged(self.terms.join(F.broadcast(known), "term", "left_semi"), "known")
        model = replace(self, terms=found, size=measure(found, "df"))
        category = decode_labels(model.transform(one, "doc_id"), self.classes).first()["category"]
        discard(found)
        return category

    def save(self, path: str) -> None:
        """Write the model as three Parquet tables into the new folder ``path``.

        A folder that exists is refused, so a model is never written over the files it is read
        from. The parameters come last: a folder without them is no model.
        """
        spark = self.terms.sparkSession
        self.terms.write.parquet(f"{path}/terms")
        self.classes.write.parquet(f"{path}/classes")
        params = {**asdict(self.settings), **asdict(self.size), "vocabulary": self.vocabulary}
        spark.createDataFrame([params], PARAMS).write.parquet(f"{path}/params")


PARAMS = (
    "lo int, hi int, min_df int, alpha double, sep string, clean string, vocabulary long, "
    "bytes long, uses double"
)


def load_model(spark: SparkSession, path: str) -> TextModel:
    """Read a saved model."""
    params = spark.read.parquet(f"{path}/params").first().asDict()
    vocabulary, size = params.pop("vocabulary"), Measure(params.pop("bytes"), params.pop("uses"))
    return TextModel(
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/classes"),
        vocabulary,
        Settings(**params),
        size,
    )


def fit(
    df: DataFrame,
    settings: Settings = Settings(),
    key: str = "doc_id",
    text: str = "text",
    category: str = "category",
) -> TextModel:
    """Train on documents with a category. NULL texts and categories are left out.

    Two passes over the texts. The first shuffles every term once per chunk of documents, with the documents it
    is in: its document frequency, and from it the vector lengths, come out of the same rows. The second sums
    the classes of each term and counts its documents again, so no vocabulary is joined to it.
    """
    s = settings
    named = df.select(key, F.col(category).alias("category"), F.col(text).alias("text")).filter(
        F.col("text").isNotNull() & F.col("category").isNotNull()
    )
    priors = pinned(nb_priors(named))
    sizes = [row.docs for row in priors.collect()]
    n, classes = sum(sizes), len(sizes)
    if classes > MAX_CLASSES:
        raise ValueError(f"{classes} classes; at most {MAX_CLASSES} can be trained")
    idf = smooth_idf(F.col("df"), F.lit(n))
    # A window over one row for each chunk of documents that has the term.
    df_of_term = F.sum(F.size("tf")).over(Window.partitionBy("term"))
    each = doc_terms(named, [key], "text", s.lo, s.hi).withColumn("df", df_of_term).filter(F.col("df") >= s.min_df)
    weighted = unnested(each.select("term", key, "tf", idf.alias("idf")), [key, "tf"])
    norms = staged(tfidf_norms(weighted, key), "norms")

    # Documents without a key have no length: they count for the frequencies, not for the sums.
    docs = encode_labels(named, priors).join(norms, key, "left")
    shares = class_shares(docs, classes, "text", s.lo, s.hi).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("used").alias("used"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(classes)]
    )
    kept = shares.filter((F.col("df") >= s.min_df) & (F.col("used") > 0)).withColumn("idf", idf)
    sums = F.array(*[F.col(f"s{c}") * F.col("idf") for c in range(classes)])
    terms = staged(kept.select("term", "df", "idf", sums.alias("sums")), "model")
    discard(norms)
    totals = terms.agg(
        F.count(F.lit(1)).alias("v"),
        *measuring(terms, "df"),
        *[F.sum(F.get("sums", F.lit(c))).alias(f"t{c}") for c in range(classes)],
    ).first()
    total = F.array(*[F.lit(float(totals[f"t{c}"] or 0.0)) for c in range(classes)])
    table = priors.withColumn("total", F.get(total, F.col("label")))
    size = Measure(totals["bytes"] or 0, totals["uses"] or 0.0)
    return TextModel(terms, table, totals["v"], settings, size)


def score_table(
    df: DataFrame, model: TextModel, key: str, text: str = "text", out: str = "predicted_category"
) -> DataFrame:
    """All columns of ``df`` plus the predicted category.

    A row finds its category by key and text together, so rows that share a key or have none are scored
    each by its own text. Rows in which both are equal are scored once.
    """
    whole = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    rows = df.withColumn("_id", F.unhex(F.md5(whole)))
    found = decode_labels(model.transform(rows, "_id", text), model.classes, out="_found")
    return rows.join(found.select("_id", "_found"), "_id", "left").select(*df.columns, F.col("_found").alias(out))


def refit(df: DataFrame, trial, key: str = "doc_id", text: str = "text", category: str = "category") -> TextModel:
    """Train on all rows with the parameters of a trial."""
    settings = Settings(trial.lo, trial.hi, trial.min_df, trial.alpha)
    return fit(df, settings, key, text, category)
