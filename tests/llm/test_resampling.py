"""Importance resampling against a plain version, with the odd rows it may meet."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from chatsift.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, lo, hi):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return len(ws), [" ".join(ws[i: i + n]) for n in range(lo, hi + 1) for i in range(len(ws) - n + 1)]


def plain_resample(docs, target, lo, hi, buckets, seed, percent, least):
    slot = lambda f: zlib.crc32(f.encode()) % buckets
    told = [(i, *plain_features(t, lo, hi)) for i, t in docs]
    s = collections.Counter(slot(f) for _, _, fs in told for f in fs)
    t = collections.Counter(slot(f) for text in target for f in plain_features(text, lo, hi)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets))))
    rows = []
    for i, n, fs in told:
        weight = sum(gain(slot(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(repr, rows))


def texts(rng, n):
    vocab = ["alpha", "Beta", "GAMMA", "été", "x9", "多", "z"] + [f"w{i}" for i in range(60)]
    return [(i, rng.choice([" ", "\n", ", ", "\x85 "]).join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("lo,hi,buckets,head", [(1, 1, 10_000, 8), (1, 2, 97, 4), (2, 3, 70_000, 16)])
def test_against_brute_force(spark, lo, hi, buckets, head):
    rng = random.Random(11)
    docs = texts(rng, 120)
    docs += [(200, None), (201, ""), (202, "?!"), (None, docs[5][1]), docs[3], (203, "same " * 5000), (204, "ÀB" * 90_000)]
    target = ["alpha beta été " * 9, None, "", "w1 w2 w3"]
    table = spark.createDataFrame([(*d, 1, "r", 0.5) for d in docs], "doc_id long, text string, score int, rank string, weight double")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = R.resample(table.repartition(5), aim, rule=R.Rule(lo, hi, buckets), seed=7, percent=30, least_words=20, head=head)
    got = sorted(repr([r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]]) for r in out.collect())
    want = plain_resample(docs, target, lo, hi, buckets, 7, 30, 20)
    assert got == want
    kept = R.drawn(table, aim, rule=R.Rule(lo, hi, buckets), seed=7, percent=30, head=head)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {eval(w)[0] for w in want if eval(w)[5]} - {None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in R.resample(one, none, least_words=1, percent=100).collect()}
    assert rows[1]["rank"] == 1 and rows[2]["rank"] is None and rows[2].weight == 0


def test_a_full_summary_keeps_the_frequent():
    c = collections.Counter({f"t{i}": 1 for i in range(40)} | {"often": 30, "more": 50})
    R.trimmed(c, 5)
    assert dict(c) == {"often": 29, "more": 49}
