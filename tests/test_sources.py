"""Reading and writing: datasets, reports, streams of frames, learned models."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chatsift.config import INTENTS
from chatsift.operators import dataset as DS, respond
from chatsift.operators import enrich, evaluate, learn
from chatsift.sources import messages as S
from chatsift.streaming import decide as ST


def test_read_split(spark, tmp_path):
    items = [{"text": f"t{i}", "labels": {k: int(k == "money") for k in INTENTS}, "category": "c", "split": "val"} for i in range(3)]
    (tmp_path / "val.json").write_text(json.dumps(items, indent=2))
    got = S.read_split(spark, str(tmp_path), "val").collect()
    assert [r["text"] for r in got] == ["t0", "t1", "t2"] and got[0]["labels"]["money"] == 1
    (tmp_path / "old.json").write_text(json.dumps([{"text": "x", "label": 1}]))
    assert S.read_split(spark, str(tmp_path), "old", legacy=True).first()["label"] == 1
    with pytest.raises(AnalysisException):
        S.read_split(spark, str(tmp_path), "missing").collect()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_splits_round_trip(spark, tmp_path, fmt):
    rows = DS.split_quick(spark.range(100).withColumn("text", F.lit("x")), 1)
    S.write_splits(rows, str(tmp_path / "d"), fmt)
    assert S.read_splits(spark, str(tmp_path / "d"), fmt=fmt).count() == 100
    test = S.read_splits(spark, str(tmp_path / "d"), "test", fmt)
    assert test.count() == rows.where("split = 'test'").count()


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, [0.9, 0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0, i % 2]) for i in range(10)],
        "id int, probs array<double>, labels array<int>")
    history = spark.createDataFrame(
        [(1, 0.5, 0.4, 0.5, 0.9)], "candidate int, train_loss double, val_loss double, val_exact_match double, val_hamming double")
    report = S.report_row(evaluate.summary(rows), evaluate.per_intent_report(rows), history, model="words", epochs=1)
    S.write_report(report, str(tmp_path / "r"))
    got = S.read_report(spark, str(tmp_path / "r")).first()
    assert got["test_exact_match"] == 0.5 and got["test_accuracy"] == 0.5  # falls back
    assert got["per_intent"]["money"]["f1"] == 1.0 and got["per_intent"]["maps"]["support"] == 5


def test_frame_stream_splits_good_and_bad(spark, tmp_path):
    frames = ['{"text": "hi", "chat_id": "a"}', "oops", '{"text": ""}']
    spark.createDataFrame([(f,) for f in frames], "value string").write.text(str(tmp_path / "in"))
    parsed = S.parse_frames(spark.readStream.text(str(tmp_path / "in")))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    ST.start_frame_split(parsed, good, bad, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(good).collect()] == ["hi"]
    assert {r["response"] for r in spark.read.parquet(bad).collect()} == {
        '{"error":"invalid JSON"}', '{"error":"text required"}'}


def test_fields_a_frame_already_has_are_replaced(spark):
    frames = ['{"text": "you owe me $5", "intents": [1], "x": {"intents": 2}, "n": null}', '{"text": "hi", "x": 1}']
    raw = spark.createDataFrame([(f,) for f in frames], "value string")
    entry = "array<struct<type:string,confidence:double,should_popup:boolean,suppressed_reason:string,cooldown_remaining_seconds:int,chat_state:string,payload_json:string,targeting:struct<addressee:string>>>"
    flat = {c: F.lit(None).cast("string") for c in respond.FLAT}
    rows = raw.withColumns({**flat, "intents": F.array().cast(entry)})
    got = [json.loads(r[0]) for r in rows.select(respond.frame_response(F.col("value"), F.col("intents"))).collect()]
    assert got[0]["intents"] == [] and got[0]["x"] == {"intents": 2} and got[0]["n"] is None and got[1]["x"] == 1
    answer = rows.select(respond.frame_response(F.col("value"), F.col("intents"))).first()[0]
    assert answer.count('"intents"') == 2  # the nested one and ours


def test_learned_scorer(spark, tmp_path):
    texts = {"money": "you owe me cash {}", "alarm": "remind me to wake {}", "contact": "save number {}",
             "calendar": "meeting scheduled {}", "maps": "navigate place {}"}
    rows = [(i, t.format(i % 7), tuple(int(k == n) for k in INTENTS)) for i, (n, t) in enumerate(list(texts.items()) * 12)]
    data = spark.createDataFrame(rows, "id int, text string, labels struct<money:int,alarm:int,contact:int,calendar:int,maps:int>")
    scorer, history = learn.search(data, data, [10.0, 0.001])
    assert history.count() == 2
    assert evaluate.summary(learn.eval_rows(scorer, data)).first()["exact_match"] == 1.0
    scorer.save(str(tmp_path / "model"))
    loaded = learn.LearnedScorer.load(spark, str(tmp_path / "model"))
    msgs = data.select(F.col("id").cast("bigint").alias("seq"), F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("sender"), "text")
    fired = enrich.fired_intents(msgs, scorer=loaded).groupBy("intent").count().collect()
    assert {r["intent"]: r["count"] for r in fired} == dict.fromkeys(INTENTS, 12)
