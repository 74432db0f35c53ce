"""Reading and writing messages, controls, frames, labelled data and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsift.config import CONTROLS_SCHEMA, EXAMPLES_SCHEMA, INTENTS, LEGACY_EXAMPLES_SCHEMA, MESSAGES_SCHEMA
from chatsift.functions.text import is_blank

FRAME_FIELDS = {
    "seq": "bigint", "ts": "timestamp", "message_id": "string",
    "chat_id": "string", "sender": "string", "text": "string",
}


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of a few unsplittable files.

    Extraction costs far more CPU than moving its input. Inputs with at least
    as many splits as cores, that is all large ones, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spread(spark.read.schema(MESSAGES_SCHEMA).format(fmt).load(path))


def read_controls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CONTROLS_SCHEMA).format(fmt).load(path)


def stream_messages(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(MESSAGES_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def parse_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    """Fields of JSON text frames; ``error`` is set on frames to reject.

    Works on tables and streams. The raw text is kept for the response.
    """
    parsed = frames.withColumn("_v", F.try_parse_json(value))
    fields = {
        name: F.try_variant_get("_v", f"$.{name}", kind)
        for name, kind in FRAME_FIELDS.items() if name not in frames.columns
    }
    out = parsed.withColumns(fields)
    error = F.when(F.col("_v").isNull(), "invalid JSON").when(is_blank(F.col("text")), "text required")
    return out.withColumn("error", error).drop("_v")


def good_frames(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNull()).drop("error")


def rejected_frames(parsed: DataFrame, value: str = "value") -> DataFrame:
    """The error frame sent back for each rejected frame."""
    return parsed.where(F.col("error").isNotNull()).select(
        value, F.to_json(F.struct("error")).alias("response")
    )


# -- labelled data ----------------------------------------------------------------

def read_split(spark: SparkSession, folder: str, split: str, legacy: bool = False) -> DataFrame:
    """One split of a labelled dataset written as a pretty-printed JSON array."""
    schema = LEGACY_EXAMPLES_SCHEMA if legacy else EXAMPLES_SCHEMA
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{split}.json")


def write_splits(examples: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """All examples, one subfolder per split; reading the folder gives the whole."""
    examples.write.mode("errorifexists").partitionBy("split").format(fmt).save(folder)


def read_splits(spark: SparkSession, folder: str, split: str | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(folder)
    return df if split is None else df.where(F.col("split") == split)


# -- training reports ---------------------------------------------------------------

_METRICS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1", "auc")]
    + [T.StructField("support", T.LongType())]
)
REPORT_SCHEMA = T.StructType([
    T.StructField("trained_at", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("intents", T.ArrayType(T.StringType())),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("test_f1", T.DoubleType()),
    T.StructField("test_exact_match", T.DoubleType()),
    T.StructField("test_hamming", T.DoubleType()),
    T.StructField("per_intent", T.StructType([T.StructField(i, _METRICS) for i in INTENTS])),
    T.StructField("training_history", T.ArrayType(T.StructType([
        T.StructField("epoch", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("val_exact_match", T.DoubleType()),
        T.StructField("val_hamming", T.DoubleType()),
    ]))),
])


def report_row(summary: DataFrame, per_intent: DataFrame, history: DataFrame, **facts) -> DataFrame:
    """One nested report row from the metrics tables (each a handful of rows)."""
    blocks = per_intent.agg(*[
        F.first(F.when(F.col("intent") == i, F.struct("precision", "recall", "f1", "auc", "support")),
                ignorenulls=True).alias(i) for i in INTENTS
    ]).select(F.struct(*INTENTS).alias("per_intent"))
    steps = history.agg(F.array_sort(F.collect_list(F.struct(
        F.col("candidate").alias("epoch"), "train_loss", "val_loss", "val_exact_match", "val_hamming",
    ))).alias("training_history"))
    one = F.lit(1).alias("_one")
    row = (
        summary.select(one, F.col("exact_match").alias("test_exact_match"), F.col("hamming").alias("test_hamming"))
        .join(blocks.select(one, "*"), "_one").join(steps.select(one, "*"), "_one").drop("_one")
    )
    return row.withColumns({k: F.lit(v) for k, v in facts.items()})


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Version info of a report; accuracy falls back to exact match."""
    r = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    return r.select(
        "trained_at",
        F.coalesce(F.nullif("test_accuracy", F.lit(0.0)), F.col("test_exact_match")).alias("test_accuracy"),
        "test_f1", "test_exact_match", "test_hamming", "per_intent", "intents",
    )
