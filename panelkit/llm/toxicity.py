"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models; each later
model also sees the earlier categories' probabilities. While training, those
are out-of-fold: the rows of a fold get theirs from models fitted without that
fold, so a later model learns how far it can trust them.

Features are the words a document contains (letters, lower case) and their
beginnings of a few lengths, by presence in the whole text; the vocabulary and the models are fitted on at most
`MOST_LABELLED` labelled rows (a hash sample, the one bound here), every
document is scored whole. Models are MLlib logistic regressions with an L1
penalty, which keeps the few words that matter.

Defined cases: a NULL or empty text has no features and gets the intercept's
probability; labels of unknown documents and NULL labels are not used; a
document's repeated labels count as its largest; a category without both
classes in the sample gets its one class's rate for all rows; an empty table
gives an empty table; repeated rows are scored each; extra columns aren't read
unless asked for with `carry`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_small, col, materialise

MOST_LABELLED = 20_000
FOLDS = 3
MIN_DOCS = 5
MOST_WORDS = 1 << 17
#: Words in more than this share of the sample are left out.
MOST_SHARE = 0.3
#: L1 penalty: this over the root of the number of training rows, the size of a word's chance correlation.
PENALTY = 0.04
ITERATIONS = 25
SIGNAL = 3.0
#: Lengths of word beginnings that are features of their own.
STEMS = (4, 5, 7)
ROWS_PER_TASK = 2_500
#: Probability from which a document is rejected.
REJECT_FROM = 0.4


def with_words(df: DataFrame, out: str = "tokens_") -> DataFrame:
    """Adds the different words of `text`, and the beginnings of longer ones as stems (marked "^")."""
    own = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))

    def stems(n: int) -> Column:
        return F.transform(F.filter("own_", lambda w: F.length(w) > n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))

    # a column of its own, so that a text is split once
    return df.withColumn("own_", own).withColumn(out, F.array_distinct(F.concat("own_", *map(stems, STEMS)))).drop("own_")


@dataclass
class Chain:
    """Fitted vocabulary and one model per category, in chain order."""

    vocabulary: CountVectorizerModel | None
    categories: list[str]
    models: list[LogisticRegressionModel | float] = field(default_factory=list)

    def features(self, docs: DataFrame) -> DataFrame:
        """Adds the feature vector `words_` of a column `text`."""
        return self.vocabulary.transform(with_words(docs)).drop("tokens_")

    def score(self, featured: DataFrame) -> DataFrame:
        """Adds p_<category> for each category, each from the ones before."""
        for k, (c, m) in enumerate(zip(self.categories, self.models)):
            featured = _predict(featured, m, [f"p_{x}" for x in self.categories[:k]], f"p_{c}")
        return featured


def _inputs(df: DataFrame, earlier: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["words_", *earlier], outputCol="inputs_").transform(df)


def _fit(df: DataFrame, earlier: list[str], label: str) -> LogisticRegressionModel | float:
    n, rate = df.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    if not n or rate in (0.0, 1.0):
        return float(rate or 0.0)
    df = df.coalesce(-(-n // ROWS_PER_TASK))
    lr = LogisticRegression(featuresCol="inputs_", labelCol=label, regParam=PENALTY / n ** 0.5, elasticNetParam=1.0,
                            standardization=False, maxIter=ITERATIONS, probabilityCol="proba_", rawPredictionCol="raw_",
                            predictionCol="class_")
    return lr.fit(_inputs(df, earlier))


def vocabulary(labelled: DataFrame, categories: list[str], n: int) -> CountVectorizerModel:
    """The features that go with some category: a word's count among the category's
    rows is `SIGNAL` standard deviations or more from chance."""
    rates = labelled.agg(*[F.avg(c).alias(c) for c in categories]).first()
    seen = with_words(labelled).select(F.explode("tokens_").alias("word"), *categories).groupBy("word").agg(
        F.count("*").alias("df"), *[F.sum(c).alias(c) for c in categories])
    least, most = min(max(MIN_DOCS, n // 1000), max(1, n // 50)), MOST_SHARE * n if n >= 50 else n
    signal = F.greatest(F.lit(0.0), *[
        F.abs(F.col(c) - F.col("df") * rates[c]) / F.sqrt(F.col("df") * rates[c] * (1 - rates[c]) * (1 - F.col("df") / (n + 1)) + 1e-9)
        for c in categories])
    kept = (seen.where((F.col("df") >= least) & (F.col("df") <= most)).withColumn("signal", signal).where(F.col("signal") >= SIGNAL)
            .orderBy(F.desc("signal"), "word").limit(MOST_WORDS).select("word").collect())
    return CountVectorizerModel.from_vocabulary([r.word for r in kept] or ["none_"], inputCol="tokens_", outputCol="words_", binary=True)


def _predict(df: DataFrame, model: LogisticRegressionModel | float, earlier: list[str], out: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    return (model.transform(_inputs(df, earlier)).withColumn(out, vector_to_array("proba_")[1])
            .drop("inputs_", "proba_", "raw_", "class_"))


def fit_chain(labelled: DataFrame, categories: list[str], folds: int = FOLDS) -> Chain:
    """`labelled`: (doc_id, text, one double 0/1 column per category), bounded and stored."""
    chain = Chain(None, categories)
    if labelled.isEmpty():
        chain.models = [0.0] * len(categories)
        return chain
    n = labelled.count()
    chain.vocabulary = vocabulary(labelled, categories, n)
    train = materialise(chain.features(labelled).withColumn("fold_", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))).drop("text"),
                        "chain-train")
    for k, c in enumerate(categories):
        earlier = [f"p_{x}" for x in categories[:k]]
        chain.models.append(_fit(train, earlier, c))
        if k + 1 < len(categories):
            held = None
            for f in range(folds):  # out of fold: the fold's rows from a model of the others
                part = _predict(train.where(F.col("fold_") == f), _fit(train.where(F.col("fold_") != f), earlier, c), earlier, f"p_{c}")
                held = part if held is None else held.union(part)
            train = materialise(held, "chain-train")
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, text, low_quality, toxic) for at most about `most` labelled rows, by hash."""
    known = (labels.select(col(id_col).cast("long").alias("doc_id"), (1 - F.col("quality")).cast("double").alias("low_quality"),
                           F.col("toxic").cast("double").alias("toxic")).dropna()
             .groupBy("doc_id").agg(F.max("low_quality").alias("low_quality"), F.max("toxic").alias("toxic")))
    share = min(1.0, most / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1 << 30)) < int(share * (1 << 30)))
    t = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialise(t.join(checked_small(some, rows=2 * most), "doc_id"), "labelled")


CATEGORIES = ["low_quality", "toxic"]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_from: float = REJECT_FROM,
             carry: list[str] | None = None, chain: Chain | None = None) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, rejected, carried columns) of every document."""
    chain = chain or fit_chain(labelled_sample(docs, labels, id_col=id_col, text_col=text_col), CATEGORIES)
    packed = F.struct(*[col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("string").alias("carried")
    t = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), packed)
    if chain.vocabulary is not None:
        t = chain.features(t)
    out = chain.score(t.drop("text"))
    return out.select("doc_id", *[f"p_{c}" for c in chain.categories], (F.col("p_toxic") >= reject_from).alias("rejected"), "carried")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of `docs` that are not rejected, all columns, in one pass."""
    scored = toxicity(docs, labels, id_col, text_col, reject_from, carry=docs.columns)
    return scored.where("not rejected").select([F.col("carried").getField(c).alias(c) for c in docs.columns])
