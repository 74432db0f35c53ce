"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Each stage works on all rows its predecessor kept. All but the last return the columns
they were given, further ones included; names may clash with an operator's own. Null
and empty texts pass the filters. Rows may lack an id or share one: the second stage
judges every row by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm import decontam, jaccard, pii, sentencepiece, toxicity
from chatsift.llm.common import read, staged

# The stages learn and iterate; no SQL says the same.
ORACLE_SQL = None

#: Near copies: shingles of so many words, sets with this Jaccard similarity at least.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over (doc_id, text, __rest), with the other columns packed away and put back in their order."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("__rest")] if others else []
    done = work(docs.select("doc_id", F.col("text").cast("string").alias("text"), *rest))
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, by a model learned from `labels`."""
    model = toxicity.learned(docs, read(spark, sf_dir, "labels"))
    return shielded(docs, lambda d: toxicity.score(d, model, out="__score").where(F.col("__score") < toxicity.THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the smallest id, null last, and of its texts the smallest.

    Texts without a word are in no component; of repeated rows (same id and text) one
    stays, and all of them where the id is null.
    """
    text = F.col("text").cast("string")
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__mark": F.coalesce(F.md5(text.cast("binary")), F.lit(""))})
    rows = staged(jaccard.grouped(
        marked.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), "text"), jaccard.Rule.of(NEAR_WORDS, NEAR_SIMILARITY)
    ), "near-rows")

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left["__id"].eqNullSafe(right["id"]) & (left["__mark"] == right["mark"]), how)

    first = rows.where("n > 0 and id <=> least")
    marks = staged(first.groupBy("label").agg(F.first("id").alias("id"), F.min("mark").alias("mark"), F.max("mark").alias("other")), "near-first")
    tied = first.join(marks.where("mark <> other").select("label"), "label").select("id", "mark", "label").distinct()
    texts = meet(marked.select("__id", "__mark", text.alias("__text")), tied, "inner").groupBy("label", "id").agg(F.min("__text").alias("text"))
    kept = (
        marks.where("mark = other").select("id", "mark").union(texts.select("id", F.md5(F.col("text").cast("binary")).alias("mark")))
        .union(rows.where("n = 0 and id is not null").select("id", "mark")).distinct()
    )
    lone = F.col("__id").isNull() & ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = meet(marked.where(~lone), kept, "left_semi").dropDuplicates(["__id", "__mark"])
    return named.union(marked.where(lone)).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    benchmark = read(spark, sf_dir, "benchmark")
    return shielded(docs, lambda d: decontam.contamination(d, benchmark).where("not contaminated"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their spans of personal data replaced by [KIND]; n_chars follows the text."""
    field = pii.train(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")))
    masked = shielded(docs, lambda d: pii.find(d, field, redact=True))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return masked


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the ids of its pieces (unsigned 32-bit), their number and checksum, and whether they decode to the text."""
    model = sentencepiece.shared_model(spark)
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return sentencepiece.encode(docs.select(*keep, "text"), model)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
