"""Operator 6: n-gram Jaccard join by rare-first prefix filtering.

A text's set: its distinct shingles of some words (A-Z lower-cased, words split at
ASCII white space), the whole sequence where there are fewer words, nothing where there
are none. Two texts link when their sets' Jaccard similarity is at least t. Shingle
length and t are a ``Rule``: 3 words and 9/10 for the query. Equal sets are one class;
links are found between classes:

1. A table of fixed size counts the shingles of all documents by hash. Every set is
   ordered rare first, and its prefix of |x| - ceil(t |x|) + 1 shingles posted:
   linked sets share a posted shingle.
2. Hubs. Each shingle's postings meet only its hub, the set with the fewest rare
   shingles, after the length filter and if they share a quarter of what they post. So a
   group of near copies costs a pair per member and posting, not all pairs, and most of
   it is connected now.
3. Within a hub's group, sets that are not connected with the hub yet. A set is the
   hub with shingles added and taken away; two sets link when these differences have
   enough in common, which again is a prefix filter, on the differences. Sets close to
   the hub share few differences with one far from it, so few pairs are left.
4. Between groups: postings of one shingle in different groups and components, under
   the length and the positional filter, if they post three in common or as many as they can.

Before texts are fetched, a pair must pass a bound on its difference: every node
carries the parity of its shingles in 1,024 bins, and sets whose parities differ in k
bins differ in k shingles at least. Every pair left is verified once: the suffix filter
bounds the difference by halving the sets, then the sets are intersected. What is left out is pairs already
known to be connected, so components are exact. Nulls and empty texts: no shingles,
linked with nothing; rows are judged one by one, whether or not ids repeat, and a null
id is never the smallest one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import SLICE_BYTES, Bounded, discard, parts, partitions, read, staged, store
from chatsift.llm.graph import components

SLOTS = 1 << 23  # of the frequency table, 2 bytes each
PIECES = 64  # rows it travels in
MOST = 65_535
BITS = 1 << 23  # of the table of wanted ids
BINS = 1 << 10  # of a set's parities
LEAST = 3  # posted shingles that sets of different groups must share, where they post that many
GROUP = Fraction(7, 10)  # similarity to a hub from which a set belongs to its group, if links need no less

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_TAKEN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the least similarity p / q of a link. Bounds are in whole numbers."""

    shingle: int
    p: int
    q: int

    @classmethod
    def of(cls, shingle: int, similarity: float) -> Rule:
        t = Fraction(similarity).limit_denominator(1000)
        if shingle < 1 or not 0 < t <= 1:
            raise ValueError("needs a shingle of one word at least and a similarity above 0, up to 1")
        return cls(shingle, t.numerator, t.denominator)

    @property
    def similarity(self) -> Fraction:
        return Fraction(self.p, self.q)

    @property
    def group(self) -> Fraction:
        return min(GROUP, self.similarity)

    @property
    def linked(self) -> str:
        return alike(self.similarity)

    def least_common(self, n: int) -> int:
        """Smallest set that a set of n can link with: ceil(t n)."""
        return -(-self.p * n // self.q)

    def posted(self, n: str) -> str:
        """SQL of the shingles that a set of n posts."""
        return f"({n} - ({self.p} * {n} + {self.q - 1}) div {self.q} + 1)"


def alike(t: Fraction) -> str:
    """SQL: verified sets have the similarity t at least."""
    return f"{t.denominator} * both >= {t.numerator} * (n_a + n_b - both)"


class Words(Bounded):
    def __missing__(self, word: bytes) -> bytes:
        self[word] = h = xxhash.xxh64(word).digest()
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K3
    return h ^ (h >> np.uint64(29))


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Of every n neighbours in h, one number that depends on their order."""
    at = len(h) - n + 1
    out = h[:at]
    for i in range(1, n):
        out = out * (_K1 if i % 2 else _K2) + h[i: at + i]
    return out


def sets(texts: list[bytes | None], memo: Words, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (63 bits) of each whole text."""
    memo.trim()
    split = [(t or b"").lower().split() for t in texts]
    h = np.frombuffer(b"".join(b"".join(map(memo.__getitem__, w)) for w in split), "<u8")
    with np.errstate(over="ignore"):
        runs = mixed(chained(h, shingle)) if len(h) >= shingle else h[:0]
        at = 0
        for w in split:
            n = len(w)
            if n >= shingle:
                s = np.sort(runs[at: at + n - shingle + 1] & ~_TAKEN)
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif n:
                yield mixed((chained(h[at: at + n], n) * _K1 + np.uint64(n)) * _K3) & ~_TAKEN
            else:
                yield h[:0]
            at += n


def key(s: np.ndarray) -> bytes:
    return xxhash.xxh128(s.tobytes()).digest()


def profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass over (id, mark, text): (id, mark, n, key) per row, and the partial frequency table of each task (piece, counts)."""

    def run(batches):
        memo, counts = Words(200_000), np.zeros(SLOTS, np.uint16)
        for batch in parts(batches):
            n, k = [], []
            for s in sets(batch.column(2).to_pylist(), memo, rule.shingle):
                at = (s % SLOTS).astype(np.int64)
                counts[at] += counts[at] < MOST  # of one text's shingles in a slot one counts
                n.append(len(s))
                k.append(key(s))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(k, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                ["id", "mark", "n", "key", "piece", "counts"],
            )
        size = SLOTS // PIECES
        for p in range(PIECES):
            piece = counts[p * size: (p + 1) * size]
            if piece.any():
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([None], pa.int64()), "mark": pa.array([None], pa.string()), "n": pa.array([None], pa.int64()), "key": pa.array([None], pa.binary()),
                    "piece": pa.array([p], pa.int32()), "counts": pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary()),
                })

    return staged(docs.mapInArrow(run, "id long, mark string, n long, key binary, piece int, counts binary"), "profiles")


class Counts:
    """The whole table, SLOTS counts whatever the input, in the shared folder: tasks write it and read it, the driver never holds it."""

    def __init__(self, path: str):
        self.path = path

    @property
    def value(self) -> np.ndarray:
        """For one task: idle workers keep nothing."""
        fs, place = store(self.path)
        out, size = np.zeros(SLOTS, np.uint16), SLOTS // PIECES
        for info in fs.get_file_info(pafs.FileSelector(place)):
            if info.extension == "parquet":
                rows = pq.ParquetFile(fs.open_input_file(info.path)).read()
                for p, c in zip(*(rows.column(x).to_pylist() for x in ("piece", "counts"))):
                    out[p * size: (p + 1) * size] = np.frombuffer(zlib.decompress(c), "<u2")
        return out


def frequencies(profile: DataFrame) -> Counts:
    """The partial tables of all tasks, added up piece by piece."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[p] = total.get(p, 0) + np.frombuffer(zlib.decompress(c), "<u2").astype(np.uint64)
        for p, c in total.items():
            c = zlib.compress(np.minimum(c, MOST).astype("<u2").tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p], pa.int32()), "counts": pa.array([c], pa.binary())})

    rows = (
        profile.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece")
        .mapInArrow(add, "piece int, counts binary").coalesce(PIECES // 8)
    )
    return Counts(staged(rows, "counts").staged_path)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each bin holds an odd number of the set's shingles, as BINS / 64 words."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % BINS, minlength=BINS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def may_differ(pairs: DataFrame, nodes_: DataFrame, similarity: float | Fraction) -> DataFrame:
    """Pairs (a, b) but for those whose parities show a lower similarity; exact, as it only drops on proof."""
    side = lambda c: nodes_.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odds").alias(f"odds_{c}"))
    apart = F.aggregate(F.zip_with("odds_a", "odds_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.lit(float((1 - similarity) / (1 + similarity))) * (F.col("n_a") + F.col("n_b")) + 1e-6
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b")


def nodes(docs: DataFrame, counts, rule: Rule) -> DataFrame:
    """A row per class: node, rep (the id of one of its rows), key, n, odds (parities) and prefix. Small nodes are sets of common shingles.

    A task gives out a class once, unless it forgets, and all of a class's rows meet in the one range they share.
    """

    def run(batches):
        memo, seen, c = Words(200_000), Bounded(100_000), counts.value
        for batch in parts(batches):
            seen.trim()
            rows = []
            for uid, s in zip(batch.column(0).to_pylist(), sets(batch.column(1).to_pylist(), memo, rule.shingle)):
                if len(s) and (k := key(s)) not in seen:
                    seen[k] = None
                    f = c[(s % SLOTS).astype(np.int64)]
                    order = np.argsort(f, kind="stable")[: len(s) - rule.least_common(len(s)) + 1]
                    rows.append((uid, k, len(s), float((1 / np.maximum(f, 1, dtype=float)).mean()), parities(s), s[order].astype(np.int64)))
            if rows:
                uid, k, n, odd, odds, prefix = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid, pa.int64()), pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(odd), *(pa.array(c, pa.list_(pa.int64())) for c in (odds, prefix))],
                    ["rep", "key", "n", "odd", "odds", "prefix"],
                )

    def first(batches):
        last = None
        for batch in batches:
            keep = []
            for k in batch.column(1).to_pylist():
                keep.append(k != last)
                last = k
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = "rep long, key binary, n long, odd double, odds array<long>, prefix array<long>"
    wide = staged(docs.mapInArrow(run, schema), "sets")  # read twice, as ranges are found by sampling
    ordered = wide.repartitionByRange(partitions(docs.sparkSession), "odd", "key").sortWithinPartitions("odd", "key", "rep")
    one = ordered.mapInArrow(first, schema)
    out = staged(one.select(F.monotonically_increasing_id().alias("node"), "rep", "key", "n", "odds", "prefix"), "nodes")
    discard(wide)
    return out


def bit_table(nodes_: DataFrame, ends: DataFrame):
    """Broadcast bits (BITS of them, whatever the input) of the ids of some nodes."""
    bit = F.pmod(F.xxhash64(F.coalesce(F.col("rep"), F.lit(-1))), F.lit(BITS)) + 1  # bits count from 1
    maps = (
        nodes_.join(ends, "node").select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    )
    table = np.zeros(BITS // 8, np.uint8)
    for r in maps:
        table[(r.bucket - 1) * 4096: r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return nodes_.sparkSession.sparkContext.broadcast(table)


def wanted_texts(docs: DataFrame, nodes_: DataFrame, pairs: DataFrame, shingle: int = 3, pack: bool = False) -> DataFrame:
    """(key, text, left, right) of classes in pairs (a, b): as some a, as some b; pack: texts as they travel, packed with zstd.

    Bit tables keep other rows out before any set is made; the few that pass by
    chance and copies of a row from different tasks meet no pair or repeat one. A copy
    may pass one table by chance before the wanted row comes, so what a class has been
    given in a task is kept by flag.
    """
    tables = [bit_table(nodes_, pairs.select(F.col(c).alias("node")).distinct()) for c in "ab"]

    def run(batches):
        memo, seen, as_sent = Words(200_000), Bounded(100_000), zstandard.ZstdCompressor(level=3).compress if pack else bytes
        left, right = (t.value for t in tables)
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            flags = [(t[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool) for t in (left, right)]
            batch = pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, flags)], ["text", "left", "right"])
            for part in parts([batch.filter(pa.array(flags[0] | flags[1]))], 0):
                seen.trim()
                rows = []
                for t, x, y, s in zip(*(c.to_pylist() for c in part.columns), sets(part.column(0).to_pylist(), memo, shingle)):
                    k = key(s)
                    given_x, given_y = seen.get(k, (False, False))
                    if len(s) and (x and not given_x or y and not given_y):
                        seen[k] = (x or given_x, y or given_y)
                        rows.append((k, as_sent(t), x and not given_x, y and not given_y))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.bool_(), pa.bool_()))],
                        ["key", "text", "left", "right"],
                    )

    bit = F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(-1))), F.lit(BITS))
    rows = docs.select("id", "text", bit.alias("bit"))
    out = staged(rows.mapInArrow(run, "key binary, text binary, left boolean, right boolean"), "texts")
    for t in tables:
        t.destroy()  # the driver would keep them
    return out


def differ_at_least(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Suffix filter: a lower bound of the number of elements in one set only, by halving both at y's middle."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    same = at < len(x) and x[at] == y[mid]
    return (
        differ_at_least(x[:at], y[:mid], depth - 1) + differ_at_least(x[at + same:], y[mid + 1:], depth - 1) + (not same)
    )


def common(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Elements in both sets; -1 where the suffix filter shows that there are fewer than ``least``."""
    if (len(x) + len(y) - differ_at_least(x, y)) // 2 < least:
        return -1
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def with_texts(pairs: DataFrame, nodes_: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs with the texts of both. What travels is packed texts, a fraction of the size of their sets."""
    keys = nodes_.select("node", "key")
    named = pairs.join(keys.select(F.col("node").alias("a"), F.col("key").alias("key_a")), "a").join(
        keys.select(F.col("node").alias("b"), F.col("key").alias("key_b")), "b"
    )
    x = texts.where("left").select(F.col("key").alias("key_a"), F.col("text").alias("x"))
    y = texts.where("right").select(F.col("key").alias("key_b"), F.col("text").alias("y"))
    return named.join(y, "key_b").join(x, "key_a").select("a", "b", "x", "y")


class Sets(Bounded):
    """Sets of recent texts: pairs come sorted by their first text's key."""

    def __init__(self, limit: int, shingle: int):
        super().__init__(limit)
        self.memo, self.shingle, self.unpack = Words(200_000), shingle, zstandard.ZstdDecompressor().decompress

    def __missing__(self, text: bytes) -> np.ndarray:
        self[text] = s = next(sets([self.unpack(text)], self.memo, self.shingle))
        return s


def both_sets(batches, shingle: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    kept, memo = Sets(20, shingle), Words(200_000)
    for batch in parts(batches, -1, SLICE_BYTES // 4):  # texts grow as they are unpacked
        kept.trim()
        texts = map(kept.unpack, batch.column(3).to_pylist())
        yield batch, ((kept[x], y) for x, y in zip(batch.column(2).to_pylist(), sets(texts, memo, shingle)))


def verified(pairs: DataFrame, nodes_: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, n_a, n_b, both) of pairs (a, b); both: common shingles, -1 if too few for a group."""

    least = rule.group / (1 + rule.group)

    def run(batches):
        for batch, couples in both_sets(batches, rule.shingle):
            rows = [(len(s), len(t), common(s, t, least.numerator * (len(s) + len(t)) // least.denominator)) for s, t in couples]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, pa.int64()) for c in zip(*rows))], ["a", "b", "n_a", "n_b", "both"]
            )

    rows = with_texts(pairs, nodes_, texts).mapInArrow(run, "a long, b long, n_a long, n_b long, both long")
    return staged(rows, "verified").distinct()


def differences(groups: DataFrame, nodes_: DataFrame, texts: DataFrame, counts, shingle: int) -> DataFrame:
    """(hub, node, n_hub, n, elements) per member (a: hub, b: node): what it adds, then what it lacks, each rare first."""

    def run(batches):
        c = counts.value
        for batch, couples in both_sets(batches, shingle):
            rows = []
            for x, y in couples:
                ordered = []
                for d, flag in ((np.setdiff1d(y, x, True), np.uint64(0)), (np.setdiff1d(x, y, True), _TAKEN)):
                    order = np.argsort(c[(d % SLOTS).astype(np.int64)], kind="stable")
                    ordered.append(d[order] | flag)
                rows.append((len(x), len(y), np.concatenate(ordered).astype(np.int64)))
            n_hub, n, elements = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n_hub, pa.int64()), pa.array(n, pa.int64()), pa.array(elements, pa.list_(pa.int64()))],
                ["hub", "node", "n_hub", "n", "elements"],
            )

    rows = with_texts(groups, nodes_, texts).mapInArrow(run, "hub long, node long, n_hub long, n long, elements array<long>")
    return rows.dropDuplicates(["hub", "node"])


def links(docs: DataFrame, nodes_: DataFrame, counts, rule: Rule) -> DataFrame:
    """Linked pairs of nodes (u, v) that connect all that is connected."""
    # dealt once by shingle: the count and the join that follow need no other shuffle of them
    postings = nodes_.select("node", "n", F.posexplode("prefix").alias("pos", "gram")).repartition("gram")
    buckets = postings.groupBy("gram").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1").drop("size")
    sizes = nodes_.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"))
    group = rule.group
    length = f"{group.denominator} * least(n, n_hub) >= {group.numerator} * greatest(n, n_hub)"
    shared = staged(postings.join(buckets, "gram"), "postings")
    # Sets that share few of their rare shingles are no group. What they share under other hubs isn't seen
    # here, so they may still link: they are left to between().
    enough = f"4 * c >= least({rule.posted('n')}, {rule.posted('n_hub')})"
    hubs = (
        shared.where("node <> hub").groupBy("hub", "node", "n").agg(F.count("*").alias("c"))
        .join(sizes, "hub").where(length).where(enough).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    )
    hubs = staged(may_differ(hubs, nodes_, group), "hub-pairs")
    hub_texts = wanted_texts(docs, nodes_, hubs, rule.shingle, pack=True)
    near = verified(hubs, nodes_, hub_texts, rule)
    first = near.where(rule.linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = staged(components(first), "labels")

    # Groups: a member's hub is the smallest one that is near enough; others are groups of their own.
    member = near.where(alike(group)).groupBy("b").agg(F.min("a").alias("a"))
    known = label.select("node", "label")
    state = staged(
        nodes_.select("node", "n").join(member.withColumnRenamed("b", "node"), "node", "left").join(known, "node", "left")
        .select("node", "n", F.coalesce("a", "node").alias("group"), F.coalesce("label", "node").alias("label")), "state",
    )
    inside, used = within(state, known, nodes_, hub_texts, counts, rule)
    across = between(shared, state, rule)
    rest = inside.union(across).distinct().join(hubs.select("a", "b"), ["a", "b"], "left_anti")
    rest = staged(may_differ(rest, nodes_, rule.similarity), "other-pairs")
    discard(shared, hubs, hub_texts, state, label, *used)
    rest_texts = wanted_texts(docs, nodes_, rest, rule.shingle, pack=True)
    more = verified(rest, nodes_, rest_texts, rule)
    discard(rest, rest_texts)
    return first.union(more.where(rule.linked).select(F.col("a").alias("u"), F.col("b").alias("v")))


def within(state: DataFrame, label: DataFrame, nodes_: DataFrame, texts: DataFrame, counts, rule: Rule) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of one group that may link though one of them is not connected with the hub, and the tables staged for them."""
    member = state.where("node <> group").join(
        label.select(F.col("node").alias("group"), F.col("label").alias("hub_label")), "group", "left"
    ).withColumn("far", F.expr("label <> coalesce(hub_label, `group`)"))
    open_ = member.where("far").select("group").distinct()
    member = staged(member.join(open_, "group").select("group", "node", "label", "far"), "members")
    d = differences(member.select(F.col("group").alias("a"), F.col("node").alias("b")), nodes_, texts, counts, rule.shingle)
    # Two sets link when (|dx| + |dy| - apart / both * (|x| + |y|)) / 2 differences are shared; each side's least value of it:
    both, apart = rule.q + rule.p, rule.q - rule.p
    least = F.expr(
        f"if(far, greatest(1, cast(({both} * size(elements) - {apart} * (n + n_hub) + {2 * both - 1}) div {2 * both} as int)),"
        f" cast(({rule.p} * size(elements)) div {both} as int) + 1)"
    )
    rows = d.join(member.select(F.col("group").alias("hub"), "node", "label", "far"), ["hub", "node"])
    prefix = F.expr("slice(elements, 1, greatest(0, size(elements) - least + 1))")
    rows = staged(rows.withColumn("least", least).select(
        "hub", "node", "label", "far", "n", F.size("elements").alias("d"), F.posexplode(prefix).alias("pos", "element")
    ), "differences")
    side = lambda r, s: r.select("hub", "element", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "far", "n", "d", "pos")])
    pairs = side(rows.where("far"), "a").join(side(rows, "b"), ["hub", "element"]).where(
        "label_a <> label_b and (node_a < node_b or not far_b)"
        # the first difference in common leaves room for the others
        f" and {2 * both} * least(d_a - pos_a, d_b - pos_b) >= {both} * (d_a + d_b) - {apart} * (n_a + n_b)"
    )
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), [member, rows]


def between(shared: DataFrame, state: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different groups and components that share LEAST of the shingles they post, or as many as their sizes ask for.

    Sets with r elements in common share l of their first n - r + l, in the order of all (for one l this is the
    positional filter); l is as large as what is posted allows.
    """
    rows = shared.join(state.select("node", "group", "label"), "node")
    home = rows.where("node = hub").select("gram", F.col("group").alias("home"))
    mixed_ = rows.groupBy("gram").agg(
        F.min("group").alias("g0"), F.max("group").alias("g1"), F.min("label").alias("l0"), F.max("label").alias("l1")
    ).where("g0 <> g1 and l0 <> l1").select("gram").join(home, "gram")
    rows = rows.select("gram", "node", "n", "pos", "group", "label").join(mixed_, "gram")
    one = rows.where("group <> home").select(*[F.col(c).alias(c if c == "gram" else c + "_a") for c in rows.columns if c != "home"])
    two = rows.select(*[F.col(c).alias(c if c == "gram" else c + "_b") for c in rows.columns])
    p, q = rule.p, rule.q
    wanted = f"({p} * (n_a + n_b) + {p + q - 1}) div {p + q}"
    shared_ = f"least({LEAST}, {wanted} - ({p} * greatest(n_a, n_b) + {q - 1}) div {q} + 1)"
    pairs = one.join(two, "gram").where(
        "group_a <> group_b and label_a <> label_b and (group_b = home_b or node_a < node_b)"
        f" and {q} * least(n_a, n_b) >= {p} * greatest(n_a, n_b)"
        f" and least(n_a - pos_a, n_b - pos_b) >= {wanted} - {shared_} + 1"
    ).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.expr(shared_).alias("l"))
    return pairs.groupBy("a", "b", "l").agg(F.count("*").alias("c")).where("c >= l").select("a", "b")


def near_duplicates(
    docs: DataFrame, *, shingle: int = 3, similarity: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) per row; links: shingles of so many words, so similar at least."""
    rows = grouped(docs.select(F.col(id_col).alias("id"), F.lit(None).alias("mark"), F.col(text_col).alias("text")), Rule.of(shingle, similarity))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, mark, n, label, least) per row of (id, mark, text); label: of its component, least: the smallest id there."""
    whole = docs.select(F.col("id").cast("long"), F.col("mark").cast("string"), F.col("text").cast("string").cast("binary").alias("text"))
    docs = whole.select("id", "text")
    profile = profiles(whole, rule)
    counts = frequencies(profile)
    nodes_ = nodes(docs, counts, rule)
    found = staged(components(links(docs, nodes_, counts, rule)), "components")
    least = profile.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"))
    joined = nodes_.select("node", "key").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")).join(least, "key")
    smallest = joined.groupBy("label").agg(F.min("rep").alias("least"))
    classes = joined.join(smallest, "label").select("key", "label", "least")
    return profile.where("piece is null").select("id", "mark", "n", "key").join(classes, "key", "left").select("id", "mark", "n", "label", "least")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, similarity=0.9)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
    ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i : i + 2]) END) AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), grams AS (
  SELECT g FROM e GROUP BY g HAVING count(*) > 1
), f AS (
  SELECT doc_id, n, g FROM e SEMI JOIN grams USING (g)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(doc_id, c) AS (
  SELECT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.c), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(sh)
"""
