"""The quality classifier: sums, solutions and curves against plain versions, held-out accuracy, odd rows."""

import os
import random

import numpy as np
import pytest

from chatsift.llm import fourier as Q


def test_statistics():
    by = dict(zip(Q.STATISTICS, Q.statistics("Ab éé 12 !! |\nAb Ab\n\nx x x".encode())))
    n = 10
    assert by["chars"] == np.log1p(26) and by["words"] == np.log1p(n) and by["lines"] == np.log1p(3)
    assert by["upper"] == 3 / 11 and by["digits"] == 2 / 26 and by["beyond_ascii"] == 2 / 26 and by["symbols"] == 1 / 26
    assert by["distinct_words"] == 6 / n and by["echoes"] == 3 / n and by["lone_marks"] == 1 / n and by["doubled_marks"] == 1 / n
    assert Q.statistics(None) == Q.statistics(b"") == [0.0] * Q.WIDTH
    assert np.isfinite(Q.statistics(b" \n ")).all() and np.isfinite(Q.statistics("é".encode() * 10**6 + b" a" * 10**6)).all()


def plain_isotonic(n, p):
    """The minimax formula: at each place the largest over starts of the smallest over ends of a block's share."""
    share = lambda a, b: p[a: b + 1].sum() / n[a: b + 1].sum()
    return [max(min(share(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]


def test_isotonic_against_minimax():
    rng = np.random.RandomState(1)
    for _ in range(40):
        n = rng.randint(1, 9, rng.randint(1, 14)).astype(float)
        p = np.floor(n * rng.uniform(0, 1.01, len(n)))
        assert np.allclose(Q.isotonic(n, p), plain_isotonic(n, p))
    assert len(Q.isotonic(np.array([]), np.array([]))) == 0


def tables(spark, n=900):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        ws = [f"{'W' if bad else 'w'}{rng.randrange(300)}{rng.choice(['!!', '', '$$$']) if bad else ''}" for _ in range(rng.randrange(3, 90))]
        docs.append((i, " ".join(ws) + ("." if not bad else ""), "x"))
        labels.append((i, 0 if bad else 1))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, docs[1][1], "x"), docs[2], docs[2]]
    labels += [(None, 1), (n, None), (3, 0), (n + 9, 1)]
    return (spark.createDataFrame(docs, "id long, text string, score string"),
            spark.createDataFrame(labels, "id long, label int"))


def test_partition_sums_and_scores_against_numpy(spark):
    docs, labels = tables(spark)
    rows = Q.described(docs)
    assert rows.columns == ["id", "score", "__stats"]
    packed = [(r.id, bytes(r["__stats"])) for r in rows.collect()]
    x = np.array([np.frombuffer(s, "<f4") for _, s in packed], float)
    mean, spread = Q.moments(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(spread, x.std(0) + 1e-6, atol=1e-5)
    features = Q.Features(mean, spread, 32, 3.0, 12)
    told = {}
    for r in labels.collect():
        if r.id is not None and r.label is not None:
            told[r.id] = max(told.get(r.id, 0), r.label)
    known = [(s, told[i]) for i, s in packed if i in told]
    z = features(np.array([np.frombuffer(s, "<f4") for s, _ in known], float))
    y, folds = np.array([v for _, v in known], float), np.array([Q.fold(s) for s, _ in known])
    frame = spark.createDataFrame([(bytearray(s), v) for s, v in known], "__stats binary, label int").repartition(7)
    sums = Q.equations(frame, features)
    for f in range(Q.FOLDS):
        mine = folds == f
        assert np.allclose(sums[f], np.vstack([z[mine].T @ z[mine], y[mine] @ z[mine]]))
    model = Q.train(rows, labels, width=32)
    ridge = 1e-3 * len(y) / 33 * np.eye(33)
    ridge[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + ridge, z.T @ y))
    assert (np.diff(model.curve) >= 0).all() and (np.diff(model.raw) > 0).all()
    got = {r.id: r.score for r in Q.score(docs, model).collect()}
    for (i, _), s in zip(packed, np.clip(np.interp(features(x) @ model.weights, model.raw, model.curve), 0, 1)):
        assert got[i] == pytest.approx(s)
    right = [(got[i] >= 0.5) == bool(v) for i, v in told.items() if i in got]
    assert np.mean(right) > 0.97


def test_empty_tables_and_labels(spark):
    docs, labels = tables(spark, 40)
    assert Q.train(Q.described(docs), labels.limit(0)) is None
    assert {r.score for r in Q.score(docs, None).collect()} == {0.0}
    none = Q.described(docs.limit(0))
    assert Q.train(none, labels) is None and Q.graded(none, None).count() == 0
    ones = Q.train(Q.described(docs), labels.where("label = 1"), width=16)
    assert min(r.score for r in Q.score(docs, ones).collect()) == 1.0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    out = Q.op12_quality_scores(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
