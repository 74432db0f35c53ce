"""The prefix trie against plain dictionaries, and its rollup against plain sums."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from chatsift.llm import prefixtrie as T


def plain_trie(rows):
    """Rows (conv, turn, role, text) to (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    told = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = told.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, turns in again.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for x in nodes:
        if x:
            kids[x[:-1]].append(x)
    leaves, saved = {}, {}
    for x in sorted(nodes, key=len, reverse=True):
        leaves[x] = sum(leaves[k] for k in kids[x]) if kids[x] else 1
        saved[x] = sum(saved[k] for k in kids[x]) + ((len(nodes[x]) - 1) * len(x[-1][1]) if x else 0)
    out = []
    for x, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(again[c]) == len(x))))
        out.append((min(members), len(x), min(nodes[x[:-1]]) if x else None, len(members), len(kids[x]), leaves[x], saved[x],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn int, role string, text string, depth string, part int, node string"


def table(spark, rows, cut=6):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(cut)


def told(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def talks(rng, n=60):
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "é🙂", "", None, "what now?", "x" * 40]))
    rows = []
    for c in rng.sample(range(400), n) + [0, 100, -7, -100]:
        rows += [(c, t, *say()) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 540) for t in range(7)]  # copies
    rows += [(600, None, "user", "before"), (600, 3, "b", "tie"), (600, 3, "a", "tie"), (600, 3, "a", "tie"), (None, 1, "a", "b"), (601, 0, None, None)]
    rows += [(700, t, "user", f"long {t % 5}") for t in range(400)] + [(701, t, "user", f"long {t % 5}") for t in range(300)]
    return rows


@pytest.mark.parametrize("block,slot", [(1 << 14, 4096), (40, 16), (3, 4)])
def test_against_dictionaries(spark, monkeypatch, block, slot):
    monkeypatch.setattr(T, "SLOT", slot)
    monkeypatch.setattr(T, "WIDEST", 10**6)
    monkeypatch.setattr(T, "PIECE", 40)
    rows = talks(random.Random(block))
    assert told(T.trie(table(spark, rows), block=block)) == plain_trie(rows)


def test_turnless_and_empty(spark):
    shared = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(shared, 0, "user", "a"), (shared, 1, "user", "b")]  # nothing of its own is left
    assert told(T.trie(table(spark, rows, 1))) == plain_trie(rows)
    assert len(plain_trie(rows)) == 1
    assert T.trie(table(spark, rows, 1).limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest"])
def test_rolled(shape):
    rng = np.random.RandomState(3)
    n = 700
    parent = np.array([-1] + [{"random": rng.randint(0, i), "chain": i - 1, "star": 0, "forest": rng.randint(-1, i)}[shape] for i in range(1, n)])
    depth = np.zeros(n, np.int64)
    weight = rng.randint(1, 9, n)
    w = rng.randint(0, 50, (n, 2))
    size, want = weight.astype(np.int64), w.astype(np.int64)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    for i in reversed(range(n)):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
            want[parent[i]] += want[i]
    mixed = rng.permutation(n)
    back = np.argsort(mixed)
    up = np.where(parent[mixed] >= 0, back[parent[mixed]], -1)
    assert (T.rolled(up, depth[mixed], size[mixed], w[mixed].astype(np.int64)) == want[mixed]).all()


def test_hash_of_parts():
    rng = random.Random(1)
    ts = [(rng.randrange(T.P), rng.randrange(T.P)) for _ in range(9)]

    def chain(part):
        f1 = f2 = 0
        for a, b in part:
            f1, f2 = (f1 * T.M1 + a) % T.P, (f2 * T.M2 + b) % T.P
        return len(part), f1, f2

    for cut in range(10):
        assert T.after(chain(ts[:cut]), *chain(ts[cut:])) == chain(ts)
