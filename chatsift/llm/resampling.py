"""Operator 11: importance resampling towards a target distribution, with a head-tail vocabulary.

A text's features are its runs of ``lo`` to ``hi`` consecutive words (A-Z lower-cased;
a word is a run of a-z, 0-9 and anything beyond ASCII), repeats counted. A feature's
bucket is the CRC-32 of its UTF-8 bytes, words joined by one space, modulo ``buckets``.

1. Head. The most frequent words, and pairs where runs of two or more are asked for,
   are found by summaries of bounded size per task over all texts. Their CRC states are
   broadcast: at most ``head`` words and as many pairs, whatever the input.
2. Buckets. A head word costs one look-up; tail words take the CRC itself, and a longer run
   goes on from the state of the run before its last word. So both give the exact bucket, and
   the head decides about speed alone. Buckets are staged per document, two or four
   bytes a feature, and totals per bucket are summed over all rows.
3. Weights. A bucket's gain is the scaled log ratio of its smoothed shares in target and
   source; a document's weight is the sum over its features. Score: weight plus Gumbel
   noise from a hash of the id, so the highest scores are a sample without replacement.
4. Draw. The share of documents with enough words that have the highest scores, ties
   to smaller ids (null last). Ranks come from range-partitioned scores and the
   number of rows in the ranges before.

Null and empty texts have no features: weight 0, never drawn. A null id hashes as
the empty text. Repeated rows are documents of their own with equal scores; which of
them has which rank is open. Empty tables: nothing, or gains from smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsift.llm.common import CRC_TABLE_SQL, crc32_sql, partitions, parts, read, staged

#: Bytes of a word as they are, A-Z in lower case, all others as spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class States(dict):
    """CRC states of head words; a tail word's is computed, not kept."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


@dataclass
class Head:
    states: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]


@dataclass(frozen=True)
class Rule:
    lo: int = 1
    hi: int = 1
    buckets: int = 10_000

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if self.buckets <= 1 << 16 else "<u4")


def bucketed(ws: list[bytes], states: States, pairs: dict, rule: Rule) -> np.ndarray:
    """Buckets of all features of a text, shorter runs first."""
    state = list(map(states.__getitem__, ws))
    out = state if rule.lo == 1 else []
    for n in range(2, rule.hi + 1):
        ends = ws[n - 1:]
        if n == 2 and pairs:
            state = [pairs[k] if (k := (a, b)) in pairs else zlib.crc32(b" " + b, s) for a, b, s in zip(ws, ends, state)]
        else:
            state = [zlib.crc32(b" " + b, s) for b, s in zip(ends, state)]
        if n >= rule.lo:
            out = out + state
    return (np.array(out, np.uint32) % rule.buckets).astype(rule.kind)


def trimmed(counts: Counter, size: int) -> None:
    """Misra-Gries: take the same amount off every counter, so that at most ``size`` stay."""
    off = sorted(counts.values(), reverse=True)[size]
    kept = {w: n - off for w, n in counts.items() if n > off}
    counts.clear()
    counts.update(kept)


def frequent(texts: DataFrame, rule: Rule, size: int) -> Head:
    """The most frequent words and pairs of a column ``text`` (binary), at most ``size`` of each."""

    def summed(batches):
        ones, twos, n = Counter(), Counter(), 0
        for batch in parts(batches, 0):
            for text in batch.column(0).to_pylist():
                ws = words(text)
                n += len(ws)
                ones.update(ws)
                if rule.hi > 1:
                    twos.update(map(b" ".join, zip(ws, ws[1:])))
            for c in (ones, twos):
                if len(c) > 4 * size:
                    trimmed(c, size)
        rows = [(w, k, c[w]) for k, c in ((1, ones), (2, twos)) for w in c if c[w] * size >= n]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64()))], ["feature", "k", "n"])

    totals = texts.mapInArrow(summed, "feature binary, k int, n long").groupBy("feature", "k").agg(F.sum("n").alias("n"))
    top = {k: [bytes(r.feature) for r in totals.where(F.col("k") == k).orderBy(F.desc("n"), "feature").limit(size).collect()]
           for k in range(1, min(rule.hi, 2) + 1)}
    return Head(
        {w: zlib.crc32(w) for w in top[1]},
        {tuple(p.split(b" ")): zlib.crc32(p) for p in top.get(2, [])},
    )


def features(texts: DataFrame, rule: Rule, head: Head) -> DataFrame:
    """The columns of texts but ``text`` (binary), with n_words, n_features and __buckets (packed)."""
    others = [c for c in texts.columns if c != "text"]
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        states, pairs = States(shared.value.states), shared.value.pairs
        for batch in parts(batches):
            rows = []
            for text in batch.column(len(others)).to_pylist():
                ws = words(text)
                b = bucketed(ws, states, pairs, rule)
                rows.append((len(ws), len(b), b.tobytes()))
            added = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*others, "n_words", "n_features", "__buckets"])

    rows = texts.select(*others, "text")
    schema = texts.select(*others).schema.add("n_words", "long").add("n_features", "long").add("__buckets", "binary")
    return rows.mapInArrow(run, schema)


def totals(rows: DataFrame, rule: Rule) -> np.ndarray:
    """Features per bucket over all rows."""

    def run(batches):
        n = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), rule.kind), minlength=rule.buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], ["bucket", "n"])

    out = np.zeros(rule.buckets, np.int64)
    for r in rows.select("__buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))) per bucket, b buckets."""
    b = float(len(source))
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log(((t + 1.0) * (s_all + b)) / ((s + 1.0) * (t_all + b))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, rule: Rule) -> DataFrame:
    """rows with ``weight`` in place of the packed buckets."""
    names = [c for c in rows.columns if c != "__buckets"]
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        g = shared.value
        for batch in batches:
            weight = [int(g[np.frombuffer(p.as_buffer(), rule.kind)].sum()) for p in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())], [*names, "weight"])

    return rows.select(*names, "__buckets").mapInArrow(run, rows.select(*names).schema.add("weight", "long"))


def gumbel(key, seed: int):
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:key")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, id_col: str, percent: int, least_words: int) -> DataFrame:
    """(__row, rank) of the drawn rows of scored (id, __row, n_words, score)."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("__row")]
    able = scored.where(F.col("n_words") >= least_words).select(F.col(id_col).alias("id"), "__row", "score")
    # The bounds of the ranges come from sampling, so the cut is kept as a table.
    cut = staged(able.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id()), "resampling-ranges")
    before, sizes = 0, {}
    for r in sorted(cut.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        sizes[r["__part"]], before = before, before + r["count"]
    drawn = percent * before // 100
    needed = [p for p, start in sizes.items() if start < drawn]
    if not needed:
        return cut.select("__row", F.lit(0).cast("long").alias("rank")).limit(0)
    start = F.create_map(*[F.lit(x).cast(t) for p in needed for x, t in ((p, "int"), (sizes[p], "long"))])
    mine = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    rows = cut.where(F.col("__part").isin(needed)).select("__row", (start[F.col("__part")] + mine).cast("long").alias("rank"))
    return rows.where(F.col("rank") <= drawn)


def resample(
    docs: DataFrame, target: DataFrame, *, rule: Rule = Rule(), seed: int = 2024, percent: int = 10, least_words: int = 20,
    head: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) per row of docs; rank is null on rows that aren't drawn."""
    text = lambda d, c: F.coalesce(d[c].cast("string").cast("binary"), F.lit(b"")).alias("text")
    source = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("__row"), text(docs, text_col))
    aim = target.select(text(target, target_col))
    top = frequent(source.select("text").union(aim), rule, head)
    rows = staged(features(source, rule, top), "resampling-buckets")
    gain = gains(totals(rows, rule), totals(features(aim, rule, top), rule))
    scored = staged(
        weighed(rows, gain, rule).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "resampling-scores"
    )
    rank = ranked(scored, "id", percent, least_words)
    return scored.join(rank, "__row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank"
    )


def drawn(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs, all columns, whose ids are drawn; rows that share an id go together, rows without one stay out."""
    ids = resample(docs, target, id_col=id_col, **settings).where("rank is not null").select(id_col).distinct()
    return docs.join(ids, id_col, "left_semi")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and rank towards `benchmark`: single words, 10,000 buckets, a tenth drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, read(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}
), docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT n, unnest(words) AS w FROM docs),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
vocab AS (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS (
  SELECT w, {crc32_sql("h")} % 10000 AS bucket
  FROM vocab, crc
),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta),
gain AS (
  SELECT bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sa + 10000) / ((s + 1.0::DOUBLE) * (ta + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), sums
),
weights AS (SELECT n, cast(sum(g) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY n),
scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (n)
),
able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""
