"""Operator 13: the trie of conversation prefixes, rolled up by centroid decomposition.

Conversations share beginnings. A node stands for a distinct sequence of first turns (role
and text); its totals over its subtree say what storing shared prefixes once saves.

1. Prefixes. Turns are range-partitioned and sorted by (conversation, turn); each task
   chains a rolling hash along its turns, and what the chain had before a cut inside a
   conversation is added afterwards, since the hash of a sequence follows from those of
   its parts. So a conversation of any length is spread over tasks. Two moduli of
   61 bits and the depth name a prefix.
2. Rebuilding. A rebuilt conversation's prefix hashes follow from the hashes of its own
   turns and of the first turns of the conversation it starts from, by the same rule.
3. Rollup. The parent-edge forest is split at centroids: the deepest node with more
   than half of its component's weight (a node weighs its members, so that sizes
   are plain sums over member turns). The component total at and below the centroid is added to
   every node on the path from the centroid to the component's top; the path is the
   centroid's conversation, cut at both depths, so it takes one join however long it
   is. Then the centroid's children's parts and the part above are components of their own. After
   log2 steps components weigh at most ``block``, and tasks go on with whole
   components in the same way, many at a time.

Of the components that still exceed the block there are at most WIDEST, so their centroids
are broadcast. Rows of a conversation are joined in slots of SLOT turns, a parent
with very many children by broadcast: no key brings a task more than its share.

Turns come in order of their number, null first, ties by a digest of role and text;
repeated rows are turns of their own. Null roles and texts are empty; rows without a
conversation are left out. Further columns are ignored. An empty table has no trie.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import CRC_TABLE_SQL, crc32_sql, partitions, read, staged

P = (1 << 61) - 1
#: Multipliers of the two rolling hashes: any numbers below P that texts can't foresee.
M1, M2 = 0x0B5E_3C71_9AD4_E62F, 0x13A7_F02D_5C86_B91B
I1, I2 = pow(M1, -1, P), pow(M2, -1, P)
ROOT = struct.pack(">IQQ", 0, 0, 0)
#: Turns of a conversation that meet in one join key, heavy components that are split at once, bytes of a piece of ids.
SLOT, WIDEST, PIECE = 4096, 10_000, 1 << 18
#: Conversations are rebuilt from those divisible by GROUP, with fewer than SHARED turns.
GROUP, SHARED = 100, 6


# -- prefixes ------------------------------------------------------------------------------


def chained(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(part, conv, pos, len, t1, t2, f1, f2): turns in order, with hashes of the turn and of the turns up to it within the part."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)
    rows = table.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.length(t).cast("long").alias("len"), digest.alias("d")
    ).select(
        "conv", "turn", "len", *[F.conv(F.substring("d", at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "t1"), (16, "t2"))],
        F.monotonically_increasing_id().alias("copy"),
    )
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("t1"), F.asc("t2"), F.asc("copy")]
    cut = rows.repartitionByRange(partitions(table.sparkSession), *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "conv", "len", "t1", "t2")

    def run(batches):
        conv, pos, f1, f2 = None, 0, 0, 0
        for batch in batches:
            out = []
            for c, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
                if c != conv:
                    conv, pos, f1, f2 = c, 0, 0, 0
                pos, f1, f2 = pos + 1, (f1 * M1 + a) % P, (f2 * M2 + b) % P
                out.append((pos, f1, f2))
            added = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], ["part", "conv", "len", "t1", "t2", "pos", "f1", "f2"])

    return cut.mapInArrow(run, "part int, conv long, len long, t1 long, t2 long, pos long, f1 long, f2 long")


def after(before: tuple, pos: int, f1: int, f2: int) -> tuple[int, int, int]:
    """Position and hashes of turns that follow (position, hashes)."""
    p, g1, g2 = before
    return p + pos, (g1 * pow(M1, pos, P) + f1) % P, (g2 * pow(M2, pos, P) + f2) % P


def carried(chains: DataFrame) -> DataFrame:
    """Chains with what a conversation had before a cut; the driver sees two turns of each part."""
    edges = chains.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos", "f1", "f2")).alias("last")).collect()
    carry: dict[int, tuple] = {}
    conv, state = None, None
    for r in sorted(edges, key=lambda r: r.part):
        if state and r.first == conv:
            carry[r.part] = (conv, state)
        end = tuple(r.last)[1:]
        state = after(state, *end) if state and r.last.conv == conv else end
        conv = r.last.conv

    def run(batches):
        for batch in batches:
            if carry.keys().isdisjoint(batch.column(0).to_pylist()):
                yield batch
                continue
            cols = batch.to_pydict()
            for i, part in enumerate(cols["part"]):
                if part in carry and carry[part][0] == cols["conv"][i]:
                    cols["pos"][i], cols["f1"][i], cols["f2"][i] = after(carry[part][1], cols["pos"][i], cols["f1"][i], cols["f2"][i])
            yield pa.RecordBatch.from_pydict(cols, schema=batch.schema)

    return chains.mapInArrow(run, chains.schema) if carry else chains


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, length, depth, len, node, parent): every prefix of every rebuilt conversation, the root included."""
    own = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    rows = turns.withColumn("h", own)
    firsts = rows.where((F.col("conv") % GROUP == 0) & (F.col("pos") < SHARED)).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("pos", "len", "t1", "t2", "f1", "f2"))).alias("head"))
    convs = rows.groupBy("conv", "h").agg(F.max("pos").alias("n"), F.max(F.when(F.col("pos") == F.col("h"), F.struct("f1", "f2"))).alias("o"))
    head = F.slice(F.coalesce("head", F.array().cast(firsts.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    zero = F.lit(0).cast("long")
    convs = staged(
        convs.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(firsts.withColumnRenamed("conv", "base"), "base", "left")
        .withColumn("head", head).withColumn("k", F.size("head").cast("long"))
        .withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), zero)),
        "trie-conversations",
    )
    start = F.get("head", (F.col("k") - 1).cast("int"))
    slots = convs.where("n > h").select(
        "conv", "length", "h", "k", *[F.coalesce(start[f], zero).alias(g) for f, g in (("f1", "g1"), ("f2", "g2"))],
        *[F.coalesce(F.col("o")[f], zero).alias(o) for f, o in (("f1", "o1"), ("f2", "o2"))],
        F.explode(F.sequence(F.floor(F.col("h") / SLOT), F.floor(F.col("n") / SLOT))).alias("slot"),
    )
    tail = rows.drop("h").withColumn("slot", F.floor(F.col("pos") / SLOT)).join(slots, ["conv", "slot"]).where("pos > h").select(
        "conv", "length", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "len", "t1", "t2", "f1", "f2",
        "g1", "g2", "o1", "o2", (F.col("pos") - F.col("h")).alias("e"),
    )
    top = convs.where("k > 0").select("conv", "length", F.inline("head")).select(
        "conv", "length", F.col("pos").alias("depth"), "len", "t1", "t2", "f1", "f2", *[zero.alias(c) for c in ("g1", "g2", "o1", "o2", "e")])

    def run(batches):
        powers = [(pow(M1, i, P), pow(M2, i, P)) for i in range(1024)]
        for batch in batches:
            nodes, parents = [], []
            for depth, t1, t2, f1, f2, g1, g2, o1, o2, e in zip(*(c.to_pylist() for c in (batch.column(2), *batch.columns[4:]))):
                p1, p2 = powers[e] if e < 1024 else (pow(M1, e, P), pow(M2, e, P))
                x1, x2 = (f1 + (g1 - o1) * p1) % P, (f2 + (g2 - o2) * p2) % P
                nodes.append(struct.pack(">IQQ", depth, x1, x2))
                parents.append(struct.pack(">IQQ", depth - 1, (x1 - t1) * I1 % P, (x2 - t2) * I2 % P))
            named = [pa.array(c, pa.binary()) for c in (nodes, parents)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *named], ["conv", "length", "depth", "len", "node", "parent"])

    paths = tail.union(top).mapInArrow(run, "conv long, length long, depth long, len long, node binary, parent binary")
    roots = convs.select("conv", "length", zero.alias("depth"), zero.alias("len"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"))
    return paths.union(roots)


# -- rollup --------------------------------------------------------------------------------


def split(parts: DataFrame, paths: DataFrame, total: int, block: int) -> DataFrame:
    """Split components heavier than the block at their centroids, all of them at once, until there is none."""
    spark = parts.sparkSession
    while True:
        heavy = parts.where((F.col("node") == F.col("comp")) & F.col("alive") & (F.col("size") > block)).select(
            "comp", F.col("size").alias("total"), F.col("depth").alias("top"))
        heavy = spark.createDataFrame(heavy.collect(), heavy.schema)  # at most total / block rows
        if heavy.isEmpty():
            return parts
        inside = parts.where("alive").join(F.broadcast(heavy), "comp")
        found = inside.where("2 * size > total").groupBy("comp", "top").agg(
            F.max_by(F.struct("node", "conv", "depth", "size"), "depth").alias("x"))
        found = found.select("comp", "top", *[F.col("x")[c].alias(f"x_{c}") for c in ("node", "conv", "depth", "size")])
        found = spark.createDataFrame(found.collect(), found.schema)
        through = paths.join(F.broadcast(found.select("comp", "x_depth", F.col("x_node").alias("parent"))), "parent").select(
            "conv", "comp", F.col("node").alias("child"),
            F.explode(F.sequence(F.floor((F.col("x_depth") + 1) / SLOT), F.floor(F.col("length") / SLOT))).alias("slot"),
        )
        mine = parts.where("alive").join(F.broadcast(found), "comp").withColumn("slot", F.floor(F.col("depth") / SLOT))
        dealt = staged(
            mine.join(through, ["conv", "comp", "slot"], "left")
            .withColumn("child", F.when(F.col("depth") > F.col("x_depth"), F.col("child"))), "trie-dealt")
        sums = dealt.where(F.col("child").isNotNull() | (F.col("node") == F.col("x_node"))).groupBy("comp").agg(
            F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
        sums = spark.createDataFrame(sums.collect(), sums.schema)
        climbs = found.join(sums, "comp").select("top", F.col("x_conv").alias("conv"), "x_depth", "b_leaves", "b_saved")
        on_path = paths.join(F.broadcast(climbs), "conv").where("depth between top and x_depth").select("node", "b_leaves", "b_saved")
        centroid, path = F.col("node") == F.col("x_node"), F.col("b_leaves").isNotNull()
        moved = dealt.join(on_path, "node", "left").withColumns({
            "add_leaves": F.col("add_leaves") + F.coalesce("b_leaves", F.lit(0)),
            "add_saved": F.col("add_saved") + F.coalesce("b_saved", F.lit(0)),
            "size": F.col("size") - F.when(path & ~centroid, F.col("x_size")).otherwise(0),
            "comp": F.coalesce("child", "comp"),
            "alive": ~centroid,
        }).select(parts.columns)
        rest = parts.where("alive").join(F.broadcast(heavy.select("comp")), "comp", "left_anti").select(parts.columns)
        parts = staged(moved.union(rest).union(parts.where("not alive")), "trie-parts")


def rolled(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of weights (one row per node) over subtrees of a forest; parent -1 at tops, sizes summed over subtrees."""
    n = len(parent)
    by_depth = np.lexsort((parent, depth))
    count = np.ones(n, np.int64)  # nodes of a subtree, from the deepest level up
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    levels = np.split(by_depth, cuts)
    for level in reversed(levels):
        inner = level[parent[level] >= 0]
        np.add.at(count, parent[inner], count[inner])
    place = np.zeros(n, np.int64)  # in an order that puts a subtree right behind its top
    tops = np.flatnonzero(parent < 0)
    place[tops] = np.cumsum(count[tops]) - count[tops]
    for level in levels:
        inner = level[parent[level] >= 0]
        if len(inner):
            p = parent[inner]
            run = np.cumsum(count[inner]) - count[inner]
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            base = np.repeat(run[first], np.diff(np.r_[first, len(inner)]))
            place[inner] = place[p] + 1 + run - base
    order = np.argsort(place)
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    span, heavy, w = count[order], size[order].copy(), weights[order]
    out = np.zeros_like(w)
    comp = np.maximum.accumulate(np.where(up < 0, np.arange(n), 0))
    live = np.arange(n)
    centroid = np.zeros(n, np.int64)
    while len(live):
        c = comp[live]
        able = live[2 * heavy[live] > heavy[c]]
        centroid[comp[able]] = able  # the last, so the deepest, of each component
        x = centroid[c]
        inside = (live >= x) & (live < x + span[x])
        sums = np.zeros_like(w)
        np.add.at(sums, c[inside], w[live[inside]])
        above = (live <= x) & (x < live + span[live])
        path = live[above]
        out[path] += sums[comp[path]]
        inner = path[path != x[above]]
        heavy_x = heavy[centroid[comp[inner]]]
        heavy[inner] -= heavy_x
        below = live[inside & (live != x)]
        if len(below):
            parts = below[up[below] == centroid[comp[below]]]
            key = np.sort(comp[parts] * n + parts)
            at = np.searchsorted(key, comp[below] * n + below, "right") - 1
            comp[below] = key[at] % n
        live = live[live != x]
    back = np.empty_like(out)
    back[order] = out
    return back


def finished(parts: DataFrame, block: int) -> DataFrame:
    """(node, n_leaves, saved): whole components go on in tasks, as many at a time as fill a block."""
    names = ["node", "parent", "comp", "depth", "size", "leaves", "saved", "add_leaves", "add_saved"]

    def totals(cols):
        node, parent, comp = (cols[c] for c in names[:3])
        at = {x: i for i, x in enumerate(node)}
        up = np.array([-1 if x == k else at[p] for x, p, k in zip(node, parent, comp)], np.int64)
        depth, size, *w = (np.array(cols[c], np.int64) for c in names[3:])
        out = rolled(up, depth, size, np.stack(w[:2], 1)) + np.stack(w[2:], 1)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), *(pa.array(c) for c in out.T)], ["node", "n_leaves", "saved"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows > 2 * block:  # all but the last component are whole
                table = pa.Table.from_batches(held)
                comp = table.column("comp").to_pylist()
                cut = comp.index(comp[-1])
                if not cut:
                    break
                yield totals(table.slice(0, cut).to_pydict())
                held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield totals(pa.Table.from_batches(held).to_pydict())

    live = parts.where("alive").select(*names).repartition("comp").sortWithinPartitions("comp")
    done = parts.where("not alive").select("node", F.col("add_leaves").alias("n_leaves"), F.col("add_saved").alias("saved"))
    return live.mapInArrow(run, "node binary, n_leaves long, saved long").union(done)


# -- ends ----------------------------------------------------------------------------------


def ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids that end at a node, in order; ids travel in pieces, and a digest reads one piece at a time."""
    order = ["node", "conv"]
    at = paths.where("depth = length").select(*order)
    cut = at.repartitionByRange(partitions(paths.sparkSession), *order).sortWithinPartitions(*order)

    def pieces(batches):
        node, first, ids, size = None, None, [], 0
        make = lambda: pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], ["node", "first", "ids"])
        for batch in batches:
            for x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (x != node or size > PIECE):
                    yield make()
                    ids, size = [], 0
                if not ids:
                    node, first = x, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield make()

    def digested(batches):
        node, sha = None, None
        make = lambda: pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])
        for batch in batches:
            for x, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if x != node:
                    if sha:
                        yield make()
                    node, sha = x, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_buffer())
        if sha:
            yield make()

    rows = cut.mapInArrow(pieces, "node binary, first long, ids string").repartition("node").sortWithinPartitions("node", "first")
    return rows.mapInArrow(digested, "node binary, ends_sha256 string")


# -- the trie ------------------------------------------------------------------------------


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv; the few parents that may have very many children are broadcast."""
    inner = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"), "n_children")
    many = max(1000, nodes.count() // 1000)
    crowded = F.broadcast(inner.where(F.col("n_children") > many).select("parent", "parent_conv"))  # a thousand at most
    few = inner.where(F.col("n_children") <= many).select("parent", "parent_conv")
    rest = nodes.where("parent is not null").join(crowded, "parent", "left_anti")
    root = nodes.where("parent is null").withColumn("parent_conv", F.lit(None).cast("long"))
    return (nodes.join(crowded, "parent").select(*nodes.columns, "parent_conv")
            .union(rest.join(few, "parent").select(*nodes.columns, "parent_conv")).union(root))


def trie(
    table: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 1 << 14,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = carried(staged(chained(table, conv, turn, role, text), "trie-turns"))
    paths = staged(rebuilt(turns), "trie-paths")
    sizes = paths.groupBy("node").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.min("len").alias("len"), F.sum(F.col("length") - F.col("depth") + 1).alias("size"),
    )
    sizes = staged(sizes, "trie-sizes")
    kids = sizes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = staged(sizes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    total = nodes.where("depth = 0").agg(F.max("size")).first()[0] or 0
    block = max(block, -(-total // WIDEST))
    zero = F.lit(0).cast("long")
    parts = nodes.select(
        "node", "conv", "depth", "parent", F.lit(ROOT).alias("comp"), "size", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("len")).alias("saved"), zero.alias("add_leaves"), zero.alias("add_saved"), F.lit(True).alias("alive"),
    )
    sums = finished(split(parts, paths, total, block), block)
    return with_parents(nodes).join(sums, "node").join(ends(paths), "node", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt `conversations`."""
    return trie(read(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
turns AS (
  SELECT conv_id, len, k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS len,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL) t
),
convs AS (
  SELECT conv_id, n, h, least(h, coalesce(m, 0)) AS shared
  FROM (SELECT conv_id, n, {crc32_sql("hex(cast(conv_id AS VARCHAR))")} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1), crc) a
  LEFT JOIN (SELECT conv_id AS base, count(*) AS m FROM turns GROUP BY 1) b ON base = conv_id - conv_id % 100
),
rows AS (
  SELECT c.conv_id, pos AS depth, k, len FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL
  SELECT c.conv_id, pos - h + shared, k, len FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
),
lists AS (SELECT conv_id, list(k ORDER BY depth) AS ks, count(*) AS length FROM rows GROUP BY 1),
prefixes AS (
  SELECT l.conv_id, length, depth, len, md5(array_to_string(ks[1:depth], '/')) AS node, md5(array_to_string(ks[1:depth - 1], '/')) AS parent
  FROM lists l JOIN rows r ON r.conv_id = l.conv_id
  UNION ALL
  SELECT c.conv_id, coalesce(length, 0), 0, 0, md5(''), NULL FROM convs c LEFT JOIN lists l ON l.conv_id = c.conv_id
),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(len) AS len,
    sha256(coalesce(string_agg(CASE WHEN depth = length THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY node
),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
weights AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.node = nodes.node),
sums AS (
  SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w.len) AS saved_tokens
  FROM weights w JOIN prefixes p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.node
)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children,
  cast(n_leaves AS BIGINT) AS n_leaves, cast(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM weights w JOIN sums ON sums.node = w.node LEFT JOIN nodes u ON u.node = w.parent
"""
