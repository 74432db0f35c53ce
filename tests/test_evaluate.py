"""Metrics against plain arithmetic on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from chatsift.config import INTENTS
from chatsift.functions import scoring
from chatsift.operators import evaluate as E


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        labels = [int(rng.random() < p) for p in (0.5, 0.3, 0.1, 0.2, 0.0)]
        probs = [min(0.999, max(0.001, round(0.25 * y + 0.7 * rng.random(), 2))) for y in labels]
        rows.append((i, f"text {i}", "cat", probs, labels))
    df = spark.createDataFrame(rows, "id bigint, text string, category string, probs array<double>, labels array<int>")
    return rows, df.persist()


def test_summary(data):
    rows, df = data
    hits = [[(p >= 0.5) == bool(y) for p, y in zip(r[3], r[4])] for r in rows]
    got = E.summary(df).first()
    assert got["exact_match"] == pytest.approx(sum(all(h) for h in hits) / len(rows))
    assert got["hamming"] == pytest.approx(sum(sum(h) for h in hits) / (5 * len(rows)))


def auc(rows, j):
    pos = [r[3][j] for r in rows if r[4][j]]
    neg = [r[3][j] for r in rows if not r[4][j]]
    if not pos or not neg:
        return 0.0
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


def test_per_intent(data):
    rows, df = data
    got = {r["intent"]: r for r in E.per_intent_report(df).collect()}
    for j, name in enumerate(INTENTS):
        tp = sum(1 for r in rows if r[4][j] and r[3][j] >= 0.5)
        predicted, support = sum(1 for r in rows if r[3][j] >= 0.5), sum(r[4][j] for r in rows)
        assert got[name]["support"] == support
        assert got[name]["auc"] == pytest.approx(auc(rows, j))
        if support:
            assert got[name]["precision"] == pytest.approx(tp / predicted if predicted else 0)
            assert got[name]["recall"] == pytest.approx(tp / support)
        else:
            assert (got[name]["precision"], got[name]["recall"], got[name]["f1"]) == (0, 0, 0)


def test_running_sum_over_buckets(spark):
    """Ranks by exact order wherever scores crowd: near 0, near 1, around a half, beyond both ends."""
    rng = random.Random(6)
    probs = [rng.choice([rng.random(), rng.random() * 1e-9, 1 - rng.random() * 1e-12, 0.5 + rng.uniform(-1e-9, 1e-9), 0.0, 1.0, -0.5, 1.5, 5e-324])
             for _ in range(500)]
    rows = [(rng.choice("ab"), p, rng.randint(0, 9)) for p in probs]
    rows = [(k, p, v) for i, (k, p, v) in enumerate(rows) if (k, p) not in {r[:2] for r in rows[:i]}] + [("a", None, 3)]
    got = E.running_sum(spark.createDataFrame(rows, "k string, p double, v int"), "k", "p", "v", "s").collect()
    assert len(got) == len(rows)
    for r in got:
        below = [v for k, p, v in rows if k == r.k and r.p is not None and (p is None or p < r.p)]
        assert r.s == sum(below)
    buckets = spark.createDataFrame([(float(p),) for p in sorted(probs)], "p double").select(E.bucket(F.col("p"))).collect()
    assert [b[0] for b in buckets] == sorted(b[0] for b in buckets)


def test_hardest_errors(data):
    rows, df = data
    wrong = [r for r in rows if any((p >= 0.5) != bool(y) for p, y in zip(r[3], r[4]))]
    want = sorted(wrong, key=lambda r: (round(min(abs(p - 0.5) for p in r[3]), 9), r[0]))[:12]
    got = E.hardest_errors(df, 12).collect()
    assert [round(r["gap"], 9) for r in got] == [round(min(abs(p - 0.5) for p in r[3]), 9) for r in want]
    assert all(r["true"] != r["predicted"] for r in got)


def test_label_names(spark):
    df = spark.createDataFrame([([1, 0, 0, 1, 0],), ([0] * 5,)], "v array<int>")
    assert [r[0] for r in df.select(E.label_names(F.col("v"))).collect()] == [["calendar", "money"], ["none"]]


def test_binary_reports(spark):
    rows = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 10
    df = spark.createDataFrame(rows, "label int, pred int")
    assert [tuple(r) for r in E.confusion(df).orderBy("label").collect()] == [(0, 10, 3), (1, 2, 5)]
    got = {r["class"]: r for r in E.class_report(df).collect()}
    assert got["1"]["precision"] == pytest.approx(5 / 8) and got["1"]["recall"] == pytest.approx(5 / 7)
    assert got["accuracy"]["f1"] == pytest.approx(0.75) and got["macro avg"]["support"] == 20
    empty = E.confusion(df.where("label = 5")).orderBy("label").collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0), (1, 0, 0)]


def test_best_candidate(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.95), (3, 0.95)], "candidate int, val_hamming double")
    assert E.best_candidate(df).first()["candidate"] == 2
    assert E.best_candidate(df, last_of_equals=True).first()["candidate"] == 3


def test_label_order():
    names = {str(i): n for i, n in enumerate(["maps", "money", "alarm", "contact", "calendar"])}
    assert scoring.label_order(names, 5) == ["maps", "money", "alarm", "contact", "calendar"]
    assert scoring.label_order({0: "LABEL_0"}, 5) == INTENTS
    assert scoring.label_order(None, 2) == ["not_money", "money"]
    with pytest.raises(ValueError):
        scoring.label_order(None, 3)


def test_softmax_does_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],)], "x array<double>")
    got = df.select(scoring.intent_probs(F.col("x"), ["not_money", "money"]).alias("p")).first()["p"]
    assert got["money"] == pytest.approx(0.7310585786) and got["alarm"] == 0.0
