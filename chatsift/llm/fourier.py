"""Operator 12: a quality classifier by random Fourier features and ridge regression.

1. Statistics. Every whole text is read once: sizes, shares of kinds of characters, word
   lengths, and how many words, word pairs and lines are repeats. They are staged, some
   eighty bytes a document, and all that follows reads them instead of the texts.
2. Features. Statistics are standardised by their mean and spread over all documents and
   mapped to cosines of random projections, whose products approximate a Gaussian kernel.
   The projections come from a seed, so every task has the same.
3. Ridge. Tasks sum the normal equations (features by features, features by labels) over
   their labelled rows; the sums of all tasks are added in two steps and solved on the
   driver. Their size depends on the number of features alone, so all labelled rows count.
4. Isotonic calibration. Sums are kept per fold (by hash of the statistics, so that copies share
   a fold); a row's raw score for the calibration is that of the other folds. Labels are
   counted in bins of raw scores, and pool-adjacent-violators over the bins gives a
   rising curve from raw scores to probabilities.

Null and empty texts have statistics 0 and are scored like any other. Labels that are null
or without an id are left out; of several labels of an id the largest counts; repeated
rows count as often as they are there. Without labelled rows every score is 0; labels of
one class give that class's score. Ties get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import parts, read, staged

STATISTICS = [
    "chars", "words", "lines", "upper", "letters", "digits", "symbols", "marks", "spaces", "beyond_ascii",
    "mean_word", "spread_word", "longest_word", "distinct_words", "distinct_pairs", "repeated_lines", "line_words", "doubled_marks",
    "echoes", "lone_marks",
]
WIDTH = len(STATISTICS)
FOLDS = 3
BINS = 2048
#: Raw scores outside this range count in the first or last bin; labels are 0 and 1.
LOW, HIGH = -0.5, 1.5
#: Partial sums that reach the driver, per fold.
GROUPS = 8
THRESHOLD = 0.5

_KINDS = ["upper", "lower", "digits", "symbols", "marks", "spaces", "lead", "inside"]


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return _KINDS.index("lead" if b >= 0xC0 else "inside")
    if c.isalpha():
        return _KINDS.index("upper" if c.isupper() else "lower")
    return _KINDS.index("digits" if c.isdigit() else "spaces" if c.isspace() else "symbols" if c in "#*$%&|<>" else "marks")


_MARKS = frozenset(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())
_TABLE = np.eye(len(_KINDS))[[_kind(b) for b in range(256)]]


def statistics(text: bytes | None) -> list[float]:
    """Numbers of one text, in the order of STATISTICS; all zero for null and empty texts."""
    if not text:
        return [0.0] * WIDTH
    upper, lower, digits, symbols, marks, spaces, lead, inside = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE
    chars = len(text) - inside
    letters = upper + lower + lead
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    doubled = sum(text.count(m) for m in (b"!!", b"??", b"..", b"--", b"||"))
    return [
        np.log1p(chars), np.log1p(n), np.log1p(len(lines)), upper / max(letters, 1), letters / chars, digits / chars, symbols / chars,
        marks / chars, spaces / chars, lead / chars, np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(sizes.max()),
        len(set(words)) / max(n, 1), len(set(zip(words, words[1:]))) / max(n - 1, 1),
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), doubled / max(n, 1),
        sum(map(eq, words, words[1:])) / max(n, 1), sum(map(_MARKS.__contains__, words)) / max(n, 1),
    ]


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``__stats`` (packed) in place of the text."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches):
        for batch in parts(batches):
            packed = [np.array(statistics(t), "<f4").tobytes() for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*others, "__stats"])

    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(*others, text.alias(text_col)).mapInArrow(run, docs.select(*others).schema.add("__stats", "binary"))


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").astype(np.float64).reshape(-1, WIDTH)


@dataclass
class Features:
    mean: np.ndarray
    spread: np.ndarray
    width: int
    reach: float
    seed: int

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features and a constant."""
        rng = np.random.RandomState(self.seed)
        w = rng.normal(size=(WIDTH, self.width)) / self.reach
        shift = rng.uniform(0, 2 * np.pi, self.width)
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / self.width) * np.cos(x @ w + shift), np.ones((len(x), 1))])


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    raw: np.ndarray
    curve: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(stats) @ self.weights, self.raw, self.curve), 0, 1)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each statistic over all rows."""

    def run(batches):
        total = np.zeros((3, WIDTH))
        for batch in batches:
            x = unpacked(batch.column(0))
            total += np.stack([np.full(WIDTH, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH), pa.int32()), *(pa.array(t) for t in total)], ["i", "n", "s", "q"])

    sums = rows.select("__stats").mapInArrow(run, "i int, n double, s double, q double").groupBy("i").agg(
        *[F.sum(c).alias(c) for c in "nsq"])
    n, s, q = np.array([[r.n, r.s, r.q] for r in sorted(sums.collect(), key=lambda r: r.i)] or np.zeros((WIDTH, 3))).T
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(q / np.maximum(n, 1) - mean * mean, 0)) + 1e-6


def fold(stats: bytes) -> int:
    """Equal statistics, so all copies of a text, have one fold."""
    return int.from_bytes(stats[:12], "little") % 1_000_003 % FOLDS


def equations(rows: DataFrame, features: Features) -> np.ndarray:
    """Sums over labelled rows (__stats, label) per fold: feature products, with the labels' as last row."""
    size = features.width + 1
    shape = (size + 1, size)

    def partial(batches):
        sums, seen = np.zeros((FOLDS, *shape)), False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            z = features(unpacked(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            folds = np.array([fold(s) for s in batch.column(0).to_pylist()], np.int64)
            for f in range(FOLDS):
                mine = folds == f
                sums[f, :size] += z[mine].T @ z[mine]
                sums[f, size] += y[mine] @ z[mine]
        if seen:
            yield from packed(sums)

    def packed(sums):
        for f in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([sums[f].tobytes()], pa.binary())], ["fold", "sums"])

    def added(batches):
        sums, seen = np.zeros((FOLDS, *shape)), False
        for batch in batches:
            for f, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[f] += np.frombuffer(s.as_buffer()).reshape(shape)
                seen = True
        if seen:
            yield from packed(sums)

    schema = "fold int, sums binary"
    parts_ = rows.select("__stats", "label").mapInArrow(partial, schema).repartition(GROUPS).mapInArrow(added, schema)
    out = np.zeros((FOLDS, *shape))
    for r in parts_.collect():  # at most FOLDS rows from each of GROUPS tasks
        out[r.fold] += np.frombuffer(bytes(r.sums)).reshape(shape)
    return out


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from summed equations; the constant's corner of the sums is the number of rows."""
    size = sums.shape[1]
    a, b = sums[:size], sums[size]
    penalty = ridge * max(a[-1, -1], 1.0) * np.eye(size) / size
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The rising shares nearest to positive / n in squares weighted by n (n > 0), by pooling adjacent violators."""
    pools: list[list[float]] = []  # rows, positives, bins
    for k, p in zip(n.tolist(), positive.tolist()):
        pools.append([k, p, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            k, p, bins = pools.pop()
            pools[-1] = [pools[-1][0] + k, pools[-1][1] + p, pools[-1][2] + bins]
    return np.repeat([p / k for k, p, _ in pools], [bins for *_, bins in pools])


def calibration(rows: DataFrame, features: Features, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and their calibrated values; ``apart`` has each fold's weights, fitted without it."""

    def run(batches):
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            z = features(unpacked(batch.column(0)))
            folds = np.array([fold(s) for s in batch.column(0).to_pylist()], np.int64)
            raw = (z * apart[folds]).sum(1)
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            counts += np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS).astype(np.int64)])
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c[used]) for c in counts)], ["bin", "n", "positive"])

    bins = rows.select("__stats", "label").mapInArrow(run, "bin int, n long, positive long").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    told = sorted(bins.collect(), key=lambda r: r.bin)
    middle = LOW + (np.array([r.bin for r in told]) + 0.5) * (HIGH - LOW) / BINS
    return middle, isotonic(np.array([r.n for r in told], float), np.array([r.positive for r in told], float))


def train(
    rows: DataFrame, labels: DataFrame, *, width: int = 256, reach: float = 3.0, ridge: float = 1e-3, seed: int = 12,
) -> Model | None:
    """Fit on described rows (id, __stats) and labels (id, label 0 or 1); None without labelled rows."""
    labels = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    known = staged(rows.select("id", "__stats").join(labels, "id").select("__stats", "label"), "quality-labelled")
    features = Features(*moments(rows), width, reach, seed)
    sums = equations(known, features)
    total = sums.sum(0)
    if not total[width, width]:
        return None
    apart = np.stack([solved(total - s, ridge) for s in sums])
    return Model(features, solved(total, ridge), *calibration(known, features, apart))


def graded(rows: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """Described rows with a score from 0 to 1 in place of their statistics."""
    if model is None:
        return rows.drop("__stats").withColumn(out, F.lit(0.0))
    names = [c for c in rows.columns if c not in ("__stats", out)]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers, whatever the input

    def run(batches):
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                scores = m.score(unpacked(batch.column(len(names))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*names, out])

    return rows.select(*names, "__stats").mapInArrow(run, rows.select(*names).schema.add(out, "double"))


def score(docs: DataFrame, model: Model | None, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs without the text, with a score."""
    return graded(described(docs.drop(out), text_col), model, out)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    rows = staged(described(docs), "quality-statistics")
    scored = graded(rows, train(rows, labels.where(~held_out(F.col("id")))))
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
