"""Learned and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsift.config import INTENTS
from chatsift.operators.evaluate import best_candidate, summary


class LearnedScorer:
    """Word features shared by five independent binary heads."""

    def __init__(self, features: PipelineModel, heads: dict[str, LogisticRegressionModel]):
        self.features, self.heads = features, heads

    def __call__(self, messages: DataFrame) -> DataFrame:
        """Add ``scores``, five probabilities in intent order."""
        df = self.features.transform(messages)
        for i, head in self.heads.items():
            df = head.transform(df).withColumn(f"_p_{i}", F.get(vector_to_array("probability"), F.lit(1)))
            df = df.drop("rawPrediction", "probability", "prediction")
        scores = F.array(*[F.col(f"_p_{i}") for i in INTENTS])
        return df.withColumn("scores", scores).drop(
            "_words", "_counts", "_features", *[f"_p_{i}" for i in INTENTS]
        )

    def save(self, path: str) -> None:
        self.features.write().save(f"{path}/features")
        for i, head in self.heads.items():
            head.write().save(f"{path}/{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LearnedScorer:
        heads = {i: LogisticRegressionModel.load(f"{path}/{i}") for i in INTENTS}
        return cls(PipelineModel.load(f"{path}/features"), heads)


def fit_features(examples: DataFrame, features: int = 1 << 16) -> PipelineModel:
    """TF-IDF words."""
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\w$+']+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features)
    idf = IDF(inputCol="_counts", outputCol="_features")
    return Pipeline(stages=[words, counts, idf]).fit(examples)


def fit_heads(ready: DataFrame, reg: float = 0.001, max_iter: int = 20) -> dict[str, LogisticRegressionModel]:
    """One logistic regression per intent on rows of (_features, labels)."""
    return {
        i: LogisticRegression(
            featuresCol="_features", labelCol="_y", regParam=reg, maxIter=max_iter
        ).fit(ready.withColumn("_y", F.col(f"labels.{i}").cast("double")))
        for i in INTENTS
    }


def train(examples: DataFrame, features: int = 1 << 16, reg: float = 0.001, max_iter: int = 20) -> LearnedScorer:
    """Five independent heads on shared word features."""
    model = fit_features(examples, features)
    ready = model.transform(examples).select("_features", "labels").persist()
    heads = fit_heads(ready, reg, max_iter)
    ready.unpersist()
    return LearnedScorer(model, heads)


def eval_rows(scorer: LearnedScorer, examples: DataFrame) -> DataFrame:
    """Examples with ``probs`` and ``labels`` arrays, as the evaluation wants them."""
    scored = scorer(examples)
    return scored.withColumn("probs", F.col("scores")).withColumn(
        "labels", F.array(*[F.col(f"labels.{i}").cast("int") for i in INTENTS])
    ).drop("scores")


def search(
    train_set: DataFrame, val_set: DataFrame, regs: Iterable[float], features: int = 1 << 16, max_iter: int = 20
) -> tuple[LearnedScorer, DataFrame]:
    """Train one scorer per strength, keep the first with the best Hamming accuracy."""
    spark = train_set.sparkSession
    model = fit_features(train_set, features)
    ready = model.transform(train_set).select("_features", "labels").persist()
    scorers, lines = [], []
    for n, reg in enumerate(regs, 1):
        scorer = LearnedScorer(model, fit_heads(ready, reg, max_iter))
        seen, held = (summary(eval_rows(scorer, part)).first() for part in (train_set, val_set))
        scorers.append(scorer)
        lines.append((n, seen["loss"], held["loss"], held["exact_match"], held["hamming"]))
    ready.unpersist()
    history = spark.createDataFrame(
        lines, "candidate int, train_loss double, val_loss double, val_exact_match double, val_hamming double"
    )
    return scorers[best_candidate(history).first()["candidate"] - 1], history


def batch_scorer(make_predict_fn: Callable, batch_size: int = 1024) -> Callable[[DataFrame], DataFrame]:
    """A scorer from any batch-inference function (texts -> rows of five scores).

    ``make_predict_fn`` loads the model once per Python worker.
    """
    score = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return lambda messages: messages.withColumn("scores", score(F.col("text")))


# -- heads by plain gradient steps --------------------------------------------------------

def word_slots(text: Column, slots: int) -> Column:
    """Distinct slots of a text's words (letters, digits, $ and '), by their CRC-32."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9$']+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.crc32(w.cast("binary")) % slots))


class GradientHeads:
    """Five logistic heads on word slots; ``weights``: one row of slot weights and a constant per intent."""

    def __init__(self, weights: list[list[float]]):
        self.weights = weights

    @property
    def slots(self) -> int:
        return len(self.weights[0]) - 1

    def __call__(self, messages: DataFrame) -> DataFrame:
        """Add ``scores``, five probabilities in intent order."""
        return messages.withColumn("scores", self.scores(word_slots(F.col("text"), self.slots)))

    def scores(self, at: Column) -> Column:
        def head(w: list[float]) -> Column:
            table = F.array(*[F.lit(float(x)) for x in w[:-1]])
            return 1 / (1 + F.exp(-F.aggregate(at, F.lit(float(w[-1])), lambda t, i: t + F.get(table, i.cast("int")))))

        return F.array(*map(head, self.weights))


def gradient_heads(examples: DataFrame, *, slots: int = 64, steps: int = 8, rate: float = 4.0) -> GradientHeads:
    """Full-batch gradient descent on the mean log loss, the same at every run and partitioning up to the order of sums.

    examples: ``text`` and ``labels`` (struct of 0/1 per intent). A step is one aggregation
    of slots times 5 numbers, whatever the number of examples; examples are read as slots once persisted.
    """
    rows = examples.select(
        word_slots(F.col("text"), slots).alias("at"), F.array(*[F.col(f"labels.{i}").cast("double") for i in INTENTS]).alias("y")
    ).persist()
    heads = GradientHeads([[0.0] * (slots + 1) for _ in INTENTS])
    n = max(rows.count(), 1)
    for _ in range(steps):
        error = F.zip_with(heads.scores(F.col("at")), F.col("y"), lambda p, y: p - y)
        cells = rows.select(F.explode(F.array_append("at", F.lit(slots).cast("long"))).alias("slot"), error.alias("e"))
        sums = cells.groupBy("slot").agg(*[F.sum(F.get("e", F.lit(k))).alias(f"g{k}") for k in range(len(INTENTS))]).collect()
        weights = [list(w) for w in heads.weights]
        for r in sums:
            for k in range(len(INTENTS)):
                weights[k][r.slot] -= rate * r[f"g{k}"] / n
        heads = GradientHeads(weights)
    rows.unpersist()
    return heads
