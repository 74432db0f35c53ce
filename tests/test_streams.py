"""Live streams: two at a time, begun from history, read while they run, run again after a failure."""

import datetime
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_policy import BASE, OUT, SCHEMA, P, histories, retell

from chatsift.operators import policy, state
from chatsift.streaming import decide as ST


def frames(spark, rows, path, cuts):
    """Rows (in order of time) as one file per slice."""
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if rows[a:b]:
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def ordered(seed, **kw):
    return sorted(histories(seed, **kw), key=lambda r: (r[2], r[3]))


def told(rows):
    return sorted(tuple(r[c] for c in OUT) for r in rows)


END = BASE + datetime.timedelta(days=400)


def test_two_streams_held_until_the_watermark(spark, tmp_path):
    """Controls come micro-batches after the messages they precede, in two streams with a watermark each; nothing is late."""
    rows = ordered(21, chats=6, length=25, gaps=(0, 1, 2, 6, 30, 90, 181))
    close = lambda n, kind: [("~", "money", END, n, kind, None, None, None)]
    talk = [r for r in rows if r[4] in ("message", "observe")] + close(-1, "message")
    ctl = [r for r in rows if r[4] not in ("message", "observe")] + close(-2, "popup_dismissed")
    frames(spark, talk, f"{tmp_path}/talk", [len(talk) // 3, len(talk) // 2])
    frames(spark, ctl, f"{tmp_path}/ctl", [len(ctl) // 6, len(ctl) - 2])
    both = source(spark, f"{tmp_path}/talk").withWatermark("ts", "1 second").unionByName(
        source(spark, f"{tmp_path}/ctl").withWatermark("ts", "3 seconds"))
    ST.start_decisions(ST.decide_stream(both, P, None, hold=True), f"{tmp_path}/out", f"{tmp_path}/progress", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("chat_id <> '~'").collect()
    assert told(got) == retell(rows) and not any(r.late for r in got)


def test_stream_goes_on_from_a_batch(spark, tmp_path):
    rows = ordered(22, chats=8, length=30)
    cut = len(rows) // 2
    while rows[cut][2] == rows[cut - 1][2]:
        cut += 1
    early = policy.decide(spark.createDataFrame(rows[:cut], SCHEMA), P)
    keys = {"money": ["amount"]}
    bodies = early.withColumn("last_payload", F.when(F.col("last_payload").isNotNull(), F.to_json(F.struct(F.col("last_payload").alias("amount")))))
    frames(spark, rows[cut:], f"{tmp_path}/in", [5, (len(rows) - cut) // 2])
    decided = ST.decide_stream(source(spark, f"{tmp_path}/in"), P, "1 hour", initial=state.trackers(bodies, None, keys))
    ST.start_decisions(decided, f"{tmp_path}/out", f"{tmp_path}/progress", available_now=True).awaitTermination()
    got = [*early.collect(), *spark.read.parquet(f"{tmp_path}/out").collect()]
    assert told(got) == retell(rows)


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """All tables of one query; its last micro-batch runs twice, as after a failure before the commit."""
    root = tmp_path_factory.mktemp("served")
    rows = ordered(23, chats=5, length=30, gaps=(0, 1, 2, 6, 30))
    late = [(rows[-1][0], "money", rows[0][2] - datetime.timedelta(days=1), -5, "message", None, None, None)]
    frames(spark, [*rows, *late], f"{root}/in", [40, 80, len(rows)])
    extra = {"message_id": "string", "sender": "string", "ordinal": "int", "confidence": "double", "targeting": "struct<a:int>", "scoped": "boolean",
             "payload": "struct<trigger_type:string,direction:string,amount:string>"}

    def run():
        events = source(spark, f"{root}/in").withColumns({c: F.lit(None).cast(t) for c, t in extra.items()}).withColumn("scoped", F.lit(True))
        d = ST.decide_stream(events, P, "1 second")
        ST.start_service(d, f"{root}/out", f"{root}/progress", P, available_now=True).awaitTermination()
        c = ST.decide_stream(events, P, "1 second")
        ST.start_counters(c, f"{root}/counters", f"{root}/progress2", "1 minute", available_now=True).awaitTermination()

    run()
    for p in ("progress", "progress2"):
        last = max(int(f) for f in os.listdir(f"{root}/{p}/commits") if f.isdigit())
        for f in (f"{last}", f".{last}.crc"):
            if os.path.exists(f"{root}/{p}/commits/{f}"):
                os.remove(f"{root}/{p}/commits/{f}")
    run()
    return rows, str(root)


def test_a_repeated_micro_batch_replaces_itself(spark, served):
    rows, root = served
    got = spark.read.parquet(f"{root}/out/decisions").collect()
    assert told(r for r in got if not r.late) == retell(rows) and sum(r.late for r in got) == 1
    answers = spark.read.parquet(f"{root}/out/control_answers")
    assert answers.count() == sum(r[4] not in ("message", "observe") for r in rows)
    replies = spark.read.parquet(f"{root}/out/replies")
    assert replies.count() == 1 + sum(r[4] in ("message", "observe") for r in rows)


def test_counters_lose_no_row(spark, served):
    rows, root = served
    c = ST.counters(spark, f"{root}/counters")
    total = c.agg(*[F.sum(x).alias(x) for x in ("detected", "popups_fired", "popups_suppressed", "late")]).first()
    pops = [r[1] for r in retell(rows) if r[1] is not None]
    assert tuple(total) == (len(pops) + 1, sum(pops), len(pops) - sum(pops), 1)
    assert c.count() == c.select("window_start", "intent").distinct().count()


def test_live_snapshot_equals_the_batch(spark, served):
    rows, root = served
    as_of = F.lit(rows[-1][2])
    live = ST.live_snapshot(spark, f"{root}/progress", as_of, P).orderBy("chat_id").collect()
    want = state.snapshot(policy.decide(spark.createDataFrame(rows, SCHEMA), P), as_of, P).orderBy("chat_id").collect()
    assert live == want and live


def test_counters_start_in_a_session_of_their_own(spark, tmp_path):
    """No other stream has chosen the state store before."""
    rows = ordered(24, chats=2, length=5)
    frames(spark, rows, f"{tmp_path}/in", [])
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    decided = ST.decide_stream(source(spark, f"{tmp_path}/in"), P, "1 hour")
    ST.start_counters(decided, f"{tmp_path}/out", f"{tmp_path}/progress", "1 minute", available_now=True).awaitTermination()
    detected = sum(r[4] == "message" for r in rows)
    assert ST.counters(spark, f"{tmp_path}/out").agg(F.sum("detected")).first()[0] == detected


class Store:
    """The states of one key and its timers, as a processor's handle."""

    def __init__(self):
        self.value, self.maps, self.timers = None, {}, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Entries())

    def registerTimer(self, ms):
        self.timers.append(ms)


class Entries(dict):
    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(list(self.items()))


class Clock(int):
    getCurrentWatermarkInMs = int.__int__


def talk(n, seconds):
    base = 1_700_000_000_000_000
    rows = [("c", "money", base + i * seconds * 1_000_000 // n, i, "message", None, None, "{}", "r" * 50, False) for i in range(n)]
    random.Random(5).shuffle(rows)
    return rows, base


def given(rows):
    return iter([pd.DataFrame(rows[i:i + 700], columns=ST._OUT.names[:10]) for i in range(0, len(rows), 700)])


def test_order_by_runs_in_a_file(monkeypatch):
    monkeypatch.setattr(ST, "SORT_CHARS", 50_000)
    rows, _ = talk(5_000, 90_000)
    rows += rows[:100]
    assert list(ST.in_order(iter(rows))) == sorted(rows, key=lambda r: (r[2], r[3])) and not list(ST.in_order(iter([])))


def test_decisions_of_a_busy_chat_leave_in_parts():
    rows, _ = talk(12_000, 90_000)
    p = ST.CooldownProcessor(P)
    p.init(Store())
    parts = list(p.handleInputRows(("c", "money"), given(rows), Clock(0)))
    assert len(parts) > 2 and max(map(len, parts)) <= ST.OUT_ROWS
    out = pd.concat(parts)
    assert list(out.seq) == list(range(12_000)) and list(out.suppression_count) and not out.late.any()


def test_a_busy_chat_is_held_in_pages():
    rows, base = talk(30_000, 90_000)
    store, whole = Store(), Store()
    p, q = ST.CooldownProcessor(P, hold=True), ST.CooldownProcessor(P)
    p.init(store)
    q.init(whole)
    for i in range(0, len(rows), 10_000):
        assert not list(p.handleInputRows(("c", "money"), given(rows[i:i + 10_000]), Clock(0)))
    held = store.maps["held"]
    assert len(held) >= 25 and max(len(v[0]) for v in held.values()) < 200_000
    got = []
    for ms in (base // 1000 + 5_400_000, base // 1000 + 5_400_000, base // 1000 + 200_000_000):
        got += [r for f in p.handleExpiredTimer(("c", "money"), Clock(ms), None) for r in f.itertuples(index=False, name=None)]
        assert all(r[2] // 1000 < ms for r in got) and (not held or max(store.timers) > ms)
    want = [r for f in q.handleInputRows(("c", "money"), given(rows), Clock(0)) for r in f.itertuples(index=False, name=None)]
    assert got == want and not held and not store.maps["hours"]


def test_columns_the_policy_does_not_read_pass_the_state(spark, tmp_path):
    extra = [
        "if(seq = 2, double('NaN'), seq * 1.1D) AS confidence", "named_struct('a', cast(NULL AS string), 'b', seq = 3) AS payload",
        "cast(NULL AS struct<x:int>) AS targeting", "timestamp_micros(1700000000123456) AS seen",
        "concat('q', chr(34), chr(92), 'ü', chr(10)) AS value", "cast(NULL AS int) AS ordinal", "array(1L, NULL) AS numbers",
    ]
    rows = ordered(25, chats=2, length=6)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(want.schema).parquet(f"{tmp_path}/in")
    ST.start_decisions(ST.decide_stream(stream, P, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/progress", available_now=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("chat_state <> 'untracked'").select(want.columns)
    kept = want.where("coalesce(chat_id, '') <> ''")
    assert got.count() == kept.count() and not got.exceptAll(kept).count()
