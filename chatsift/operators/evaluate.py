"""Model quality: multi-label and binary metrics, AUC, errors, best candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chatsift.config import INTENTS


def label_vector(labels: Column) -> Column:
    return F.array(*[labels[i].cast("double") for i in INTENTS])


def predictions(probs: Column, threshold: float = 0.5) -> Column:
    return F.transform(probs, lambda p: (p >= threshold).cast("int"))


def label_names(vector: Column, names: list[str] = INTENTS) -> Column:
    """Sorted names of the labels that are set, ``["none"]`` if none is."""
    picked = F.array_compact(F.array(*[F.when(F.get(vector, F.lit(i)) == 1, n) for i, n in enumerate(names)]))
    return F.when(F.size(picked) == 0, F.array(F.lit("none"))).otherwise(F.array_sort(picked))


def cells(rows: DataFrame, names: list[str] = INTENTS, threshold: float = 0.5) -> DataFrame:
    """(example, intent) cells of rows holding ``probs`` and ``labels`` arrays."""
    items = F.array(*[
        F.struct(
            F.lit(n).alias("intent"), F.get("probs", F.lit(i)).alias("prob"),
            F.get("labels", F.lit(i)).cast("int").alias("label"),
        )
        for i, n in enumerate(names)
    ])
    return rows.select("*", F.inline(items)).withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def summary(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Exact-match accuracy, Hamming accuracy and mean loss in one pass."""
    pairs = F.arrays_zip("probs", "labels")
    hits = F.aggregate(
        pairs, F.lit(0), lambda a, x: a + ((x["probs"] >= threshold).cast("int") == x["labels"]).cast("int")
    )
    loss = F.aggregate(
        pairs, F.lit(0.0),
        lambda a, x: a - F.when(x["labels"] == 1, F.log(x["probs"])).otherwise(F.log1p(-x["probs"])),
    )
    n = F.size("labels")
    return rows.select(hits.alias("h"), loss.alias("l"), n.alias("n")).agg(
        F.avg((F.col("h") == F.col("n")).cast("int")).alias("exact_match"),
        (F.sum("h") / F.sum("n")).alias("hamming"),
        (F.sum("l") / F.sum("n")).alias("loss"),
        F.count("*").alias("examples"),
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / F.nullif(den, F.lit(0)))


def _prf(tp: Column, predicted: Column, support: Column) -> dict[str, Column]:
    # 2tp / (predicted + support) equals the harmonic mean of the two ratios
    return {
        "precision": _ratio(tp, predicted), "recall": _ratio(tp, support),
        "f1": _ratio(2 * tp, predicted + support),
    }


def _points(long: DataFrame) -> DataFrame:
    """Cells counted per (intent, probability): all that the metrics below need."""
    return long.groupBy("intent", "prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def _auc() -> Column:
    # each positive beats the negatives below it and half of those tied with it
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return _ratio(wins, F.sum("pos") * F.sum("neg"))


def per_intent_report(rows: DataFrame, names: list[str] = INTENTS, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, AUC and support per intent; zeros without support."""
    ranked = running_sum(_points(cells(rows, names, threshold)), "intent", "prob", "neg", "below")
    hit = F.col("prob") >= threshold
    counts = ranked.groupBy("intent").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("pos") + F.col("neg")).otherwise(0)).alias("predicted"),
        F.sum("pos").alias("support"), _auc().alias("auc"),
    )
    ratios = _prf(F.col("tp"), F.col("predicted"), F.col("support"))
    has = F.col("support") > 0
    return counts.select(
        "intent", *[F.when(has, c).otherwise(0.0).alias(n) for n, c in ratios.items()], "auc", "support"
    )


def bucket(prob: Column) -> Column:
    """A whole number that never falls as the probability rises, with narrow buckets near 0 and 1, where scores crowd."""
    fine = F.when(prob < 0.5, F.floor(F.log2(prob) * 64)).otherwise(-F.floor(F.log2(1 - prob) * 64))
    return F.when(prob.isNull(), -(10**6)).when(prob <= 0, -(10**5)).when(prob >= 1, 10**5).otherwise(fine).cast("long")


def running_sum(rows: DataFrame, key: str, prob: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over rows of the key with a smaller probability; one row per probability is expected.

    Rows are ranked inside buckets of probabilities; what lies below a bucket comes
    from the sums of the others, of which a key has some hundred thousand at most.
    """
    parted = rows.withColumn("_bucket", bucket(F.col(prob)))
    sums = parted.groupBy(key, "_bucket").agg(F.sum(value).alias("_part"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_bucket", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(key, "_bucket").orderBy(prob).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parted.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return ranked.join(offsets, [key, "_bucket"]).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_bucket", "_offset", "_inside")


# -- binary (legacy) --------------------------------------------------------------

def confusion(rows: DataFrame) -> DataFrame:
    """2×2 counts by (label, pred), zeros included; one row per label."""
    n = lambda l, p: F.count_if((F.col("label") == l) & (F.col("pred") == p))
    wide = rows.agg(*[n(l, p).alias(f"n{l}{p}") for l in (0, 1) for p in (0, 1)])
    lines = F.array(*[
        F.struct(F.lit(l).alias("label"), F.col(f"n{l}0").alias("pred_0"), F.col(f"n{l}1").alias("pred_1"))
        for l in (0, 1)
    ])
    return wide.select(F.inline(lines))


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted means, accuracy."""
    m = {r: F.col(f"n{r[0]}{r[1]}") for r in ("00", "01", "10", "11")}
    n = lambda l, p: F.count_if((F.col("label") == l) & (F.col("pred") == p))
    wide = rows.agg(*[n(l, p).alias(f"n{l}{p}") for l in (0, 1) for p in (0, 1)])
    classes = {
        "0": (m["00"], m["00"] + m["10"], m["00"] + m["01"]),
        "1": (m["11"], m["01"] + m["11"], m["10"] + m["11"]),
    }
    total = m["00"] + m["01"] + m["10"] + m["11"]
    ratios = {k: _prf(*v) for k, v in classes.items()}
    support = {k: v[2] for k, v in classes.items()}
    names = ("precision", "recall", "f1")

    def line(name: str, values: dict[str, Column], size: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *[values[x].alias(x) for x in names], size.alias("support")
        )

    macro = {x: (ratios["0"][x] + ratios["1"][x]) / 2 for x in names}
    weighted = {
        x: _ratio(ratios["0"][x] * support["0"] + ratios["1"][x] * support["1"], total) for x in names
    }
    accuracy = _ratio(m["00"] + m["11"], total)
    return wide.select(F.inline(F.array(
        *[line(k, ratios[k], support[k]) for k in ("0", "1")],
        line("macro avg", macro, total), line("weighted avg", weighted, total),
        line("accuracy", dict.fromkeys(names, accuracy), total),
    )))


# -- errors, candidates, losses -------------------------------------------------------

def hardest_errors(rows: DataFrame, n: int = 15, threshold: float = 0.5, names: list[str] = INTENTS) -> DataFrame:
    """The n wrong examples whose closest probability is nearest to 0.5."""
    pred = predictions(F.col("probs"), threshold)
    gap = F.array_min(F.transform("probs", lambda p: F.abs(p - 0.5)))
    return (
        rows.withColumn("preds", pred).where(F.col("preds") != F.col("labels").cast(T.ArrayType(T.IntegerType())))
        .withColumn("gap", gap).orderBy("gap", "id").limit(n)
        .select(
            "id", "category", "text", "gap", "probs",
            label_names(F.col("labels"), names).alias("true"), label_names(F.col("preds"), names).alias("predicted"),
        )
    )


def best_candidate(history: DataFrame, metric: str = "val_hamming", last_of_equals: bool = False) -> DataFrame:
    """The history row with the best metric; the first of equals unless told otherwise."""
    order = F.col("candidate") if last_of_equals else -F.col("candidate")
    row = F.max_by(F.struct(*history.columns), F.struct(F.col(metric), order))
    return history.agg(row.alias("best")).select("best.*")


def train_accuracy(rows: DataFrame) -> DataFrame:
    """Mean log-loss and accuracy of (prob, label, pred) rows."""
    loss = F.when(F.col("label") == 1, -F.log("prob")).otherwise(-F.log1p(-F.col("prob")))
    return rows.agg(
        F.avg(loss).alias("loss"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy")
    )
