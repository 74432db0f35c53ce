"""Sessions and as-of joins against plain loops, with hot keys, ties and odd rows."""

import datetime
import random

import pytest

from chatsift.operators import history

BASE = datetime.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else BASE + datetime.timedelta(seconds=seconds)


def events(seed, n=300, hot=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        rows.append((rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), rng.randrange(40) * 37.5, i))
    now = 0.0
    for i in range(hot):
        now += rng.choice([0, 1, 3, 8, 60, 61, 400])
        rows.append(("hot", "x", now, n + i))
    rows += [("a", "x", None, 9000), ("a", None, 5.0, 9001), ("a", "x", 5.0, 9002), ("a", "x", 5.0, 9002)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(c, i, at(t), s, "z") for c, i, t, s in rows], "chat_id string, intent string, ts timestamp, seq long, known string")


@pytest.mark.parametrize("piece", [30, 500, 86_400])
def test_sessions(spark, piece):
    rows = events(1)
    got = history.sessions(frame(spark, rows), 60, ["chat_id", "intent"], piece_seconds=piece)
    assert got.columns == ["chat_id", "intent", "ts", "seq", "known", "session"]
    want, last = [], {}
    for c, i, t, s in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[3])):
        n = None
        if c and i and t is not None:
            before, n = last.get((c, i), (None, 0))
            n += before is None or t - before > 60
            last[c, i] = (t, n)
        want.append((s, n))
    assert sorted(map(repr, want)) == sorted(repr((r.seq, r.session)) for r in got.collect())
    totals = history.session_totals(got, ["chat_id", "intent"])
    assert totals.agg({"events": "sum"}).first()[0] == sum(n is not None for _, n in want)
    assert history.sessions(frame(spark, []), 60, ["chat_id", "intent"]).count() == 0


@pytest.mark.parametrize("piece,inclusive", [(30, False), (700, True), (86_400, False)])
def test_as_of(spark, piece, inclusive):
    left, right = events(2), [r for r in events(3) if r[3] != 9002]
    told = frame(spark, right).withColumnRenamed("known", "value").withColumn("n", history.F.col("seq") * 2)
    got = history.as_of(frame(spark, left).drop("known"), told, ["chat_id", "intent"], ["seq", "n"], inclusive=inclusive, piece_seconds=piece)
    want = []
    for c, i, t, s in left:
        before = [] if None in (c, i, t) else [
            (u, z) for d, j, u, z in right if (d, j) == (c, i) and u is not None and ((u, z) < (t, s) or inclusive and (u, z) == (t, s))]
        z = max(before)[1] if before else None
        want.append((s, z, None if z is None else 2 * z))
    out = [(r.seq, r.known and r.known.seq, r.known and r.known.n) for r in got.collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, out))


def test_pieces_share_one_shuffle(spark):
    """The window, the totals of the pieces and the join back use one partitioning; no step is a join of all with all."""
    plan = history.sessions(frame(spark, events(1)), 60, ["chat_id", "intent"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
