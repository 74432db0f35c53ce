"""The fold against a literal re-telling of the rules, in every layout."""

import datetime
import json
import random
import re

import pytest

from chatsift.config import PolicyParams
from chatsift.operators import policy
from chatsift.streaming import decide as ST

P = PolicyParams(cooldown=30, dismissed=90, grace=6, eviction=180)
BASE = datetime.datetime(2024, 1, 1)
SCHEMA = (
    "chat_id string, intent string, ts timestamp, seq bigint, kind string, key1 string, key2 string, payload_json string"
)
OUT = ["seq", "should_popup", "suppressed_reason", "cooldown_remaining_seconds", "chat_state", "popup_count",
       "suppression_count", "existed", "previous_state"]
KINDS = ["message"] * 12 + ["observe"] * 3 + ["payment_complete", "popup_dismissed", "reset_cooldown"]


def histories(seed, chats, length, kinds=KINDS, amounts=(None, "$1", "$2"), hot=0, gaps=(0, 1, 2, 6, 30, 90, 181)):
    rng, rows, seq = random.Random(seed), [], 0
    sizes = {f"c{i}": length for i in range(chats)}
    if hot:
        sizes["hot"] = hot
    for chat, n in sizes.items():
        at = 0.0
        for _ in range(n):
            at += rng.choice(gaps) * rng.choice([1, 1, 0.5])
            seq += 1
            kind, key = rng.choice(kinds), rng.choice(amounts)
            rows.append((chat, "money", BASE + datetime.timedelta(seconds=at), seq, kind,
                         key if kind in ("message", "payment_complete") else None, None, key))
    return rows


def retell(rows):
    """One event after the other, with a dictionary of trackers."""
    trackers, out = {}, []
    for chat, intent, ts, seq, kind, key, _, _ in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        now, k = (ts - BASE).total_seconds(), (chat, intent)
        if k in trackers and now - trackers[k]["event"] > P.eviction:
            del trackers[k]
        s = trackers.get(k)
        before, existed = (s["state"], True) if s else ("idle", False)
        pop = why = left = None
        if kind == "message":
            pop, left = True, 0
            if s and s["state"] == "post_payment":
                if now - s["event"] < P.grace:
                    pop, why, left = False, "post_payment_grace", int(P.grace - (now - s["event"]))
            elif s:
                window = P.dismissed if s["state"] == "dismissed" else P.cooldown
                changed = s["amount"] and key and s["amount"] != key
                if now - s["popup"] < window and not changed:
                    pop, left = False, int(window - (now - s["popup"]))
                    why = "recently_dismissed" if s["state"] == "dismissed" else "cooldown_active"
            if pop:
                trackers[k] = dict(state="cooldown", popup=now, event=now, amount=key,
                                   fired=(s["fired"] if s else 0) + 1, quiet=s["quiet"] if s else 0)
            else:
                s["quiet"] += 1
        elif kind == "payment_complete":
            old = s or dict(popup=now, amount=None, fired=0, quiet=0)
            trackers[k] = dict(old, state="post_payment", event=now, amount=key or old["amount"])
        elif kind == "popup_dismissed":
            old = s or dict(amount=None, fired=0, quiet=0)
            trackers[k] = dict(old, state="dismissed", popup=now, event=now)
        elif kind == "reset_cooldown":
            trackers.pop(k, None)
        t = trackers.get(k)
        out.append((seq, pop, why, left, t["state"] if t else "idle", t["fired"] if t else 0,
                    t["quiet"] if t else 0, existed, before))
    return sorted(out)


def run(spark, rows, partitions=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    if partitions:
        df = df.repartition(partitions)
    return sorted(tuple(r) for r in policy.decide(df, P, **kw).select(OUT).collect())


def test_replay_equals_the_rules(spark):
    rows = histories(1, chats=60, length=40)
    assert run(spark, rows) == retell(rows)


@pytest.mark.parametrize("seed,piece", [(2, 7), (3, 60), (8, 400)])
def test_hot_chat_in_pieces_equals_the_rules(spark, seed, piece):
    rows = histories(seed, chats=4, length=50, hot=600)
    assert run(spark, rows, piece_seconds=piece) == retell(rows)


def test_hot_chat_that_never_pauses(spark):
    """No reset, no pause, no new amount: every chunk depends on the one before."""
    rows = histories(4, chats=1, length=30, hot=500, kinds=["message"], amounts=(None,), gaps=(1, 2))
    assert run(spark, rows, piece_seconds=20) == retell(rows)


def test_hot_chat_with_only_dismissals_and_payments(spark):
    rows = histories(5, chats=0, length=0, hot=400, kinds=["message", "popup_dismissed", "payment_complete"], gaps=(1, 7))
    assert run(spark, rows, piece_seconds=15) == retell(rows)


def test_partitioning_does_not_matter(spark):
    rows = histories(6, chats=10, length=40)
    assert run(spark, rows, partitions=1) == run(spark, rows, partitions=7)


def test_untracked_rows_never_form_a_group(spark):
    rows = [(c, "money", BASE, i, "message", None, None, None) for i, c in enumerate([None, ""] * 50)]
    got = run(spark, rows)
    assert len(got) == 100 and all(r[1] is True and r[4] == "untracked" for r in got)


@pytest.mark.parametrize("seed", range(40))
def test_tables_of_pieces_tell_the_end_for_any_entry(seed):
    """Without Spark: leaving a piece by its table equals folding it, from many trackers."""
    rng = random.Random(seed)
    params = rng.choice([P, PolicyParams(cooldown=30, dismissed=90, grace=6, eviction=20), PolicyParams(cooldown=5, dismissed=2, grace=50, eviction=60)])
    kinds = rng.choice([KINDS, ["message"], ["message"] * 30 + ["popup_dismissed"], ["message", "payment_complete", "popup_dismissed", "observe"]])
    events, at = [], 10**9
    for _ in range(rng.randrange(1, 80)):
        at += rng.choice([0, 1, 2, 6, 19]) * 10**6 + rng.randrange(2)
        kind, key = rng.choice(kinds), rng.choice([None, "", "$1", "$2"])
        events.append((kind, at, key if kind in ("message", "payment_complete") else None, rng.choice([None, "a", "b"]) if kind == "message" else None, key))
    told = json.loads(json.dumps(policy.table(events, params)))
    for _ in range(40):
        born = events[0][1] - rng.randrange(params.eviction * 10**6)
        entry = rng.choice([None, policy.Tracker(
            rng.choice(["cooldown", "dismissed", "post_payment"]), born - rng.choice([0, 3 * 10**6]), born, rng.choice([None, "$1", "$3"]), rng.choice([None, "a"]), None, 7, 9, "r")])
        want = entry
        for e in events:
            want, _ = policy.advance(want, e[0], e[1], *e[2:], params)
        got = policy.leave(entry, told[2], told[3], params) if told[2] else told[1] and policy.Tracker(*told[1])
        assert got == want, (entry, events)


def test_same_plan_for_any_number_of_pieces(spark):
    """One job, without a collect: the plan is lazy and the same for five pieces and for fifty."""
    rows = histories(4, chats=1, length=30, hot=500, kinds=["message"], amounts=(None,), gaps=(1, 2))
    events = spark.createDataFrame(rows, SCHEMA)
    status = spark.sparkContext.statusTracker()
    jobs = []
    for piece in (150, 15):
        spark.sparkContext.setJobGroup(f"pieces {piece}", "")
        policy.decide(events, P, piece_seconds=piece).select(OUT).collect()
        jobs.append(len(status.getJobIdsForGroup(f"pieces {piece}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """The same history in four micro-batches, the last of which has a late row."""
    root = tmp_path_factory.mktemp("stream")
    rows = sorted(histories(7, chats=12, length=30, gaps=(0, 1, 2, 6, 30)), key=lambda r: (r[2], r[3]))
    late = (rows[0][0], "money", rows[-1][2] - datetime.timedelta(seconds=1), -1, "message", "$9", None, None)
    newest = max(r[2] for r in rows if r[0] == late[0])
    late = (*late[:2], newest - datetime.timedelta(microseconds=1), *late[3:])
    cut = len(rows) // 3
    for part in (rows[:cut], rows[cut:2 * cut], rows[2 * cut:], [late]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    events = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    )
    ST.start_decisions(
        ST.decide_stream(events, P, "1 hour"), f"{root}/out", f"{root}/progress", available_now=True
    ).awaitTermination()
    return rows, spark.read.parquet(f"{root}/out").select(*OUT, "late").collect()


def test_stream_equals_replay(streamed):
    rows, got = streamed
    assert sorted(tuple(r)[:-1] for r in got if not r["late"]) == retell(rows)


def test_late_rows_are_reported_and_change_nothing(streamed):
    _, got = streamed
    late = [r for r in got if r["late"]]
    assert [r["seq"] for r in late] == [-1] and late[0]["should_popup"] is None


def test_idle_trackers_leave_the_stream_state(spark, tmp_path):
    """Once the watermark has passed a tracker's eviction, its state is gone."""
    hours = [("idle", 0), ("busy", 2), ("busy", 2.1), ("busy", 2.2)]
    for seq, (chat, h) in enumerate(hours):
        row = (chat, "money", BASE + datetime.timedelta(hours=h), seq, "message", None, None, None)
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ST.start_decisions(
        ST.decide_stream(events, P, "1 second"), f"{tmp_path}/out", f"{tmp_path}/progress", available_now=True
    ).awaitTermination()
    kept = (
        spark.read.format("statestore").option("stateVarName", "tracker").load(f"{tmp_path}/progress")
    )
    assert {r["key"]["chat_id"] for r in kept.select("key").collect()} == {"busy"}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_tables_take_only_what_they_read(spark, tmp_path):
    """Carried columns go to Python once, for the fold, and the rows are still shuffled once."""
    rows = histories(3, 3, 40)
    spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "named_struct('a', seq, 'b', kind) AS payload", "map(kind, seq) AS counts", "concat('m', seq) AS name"
    ).write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    narrow = policy._read_by_tables(events.selectExpr("*", "unix_micros(ts) AS _us", "0L AS _piece"), [*policy.KEY, "_piece", "ts", "seq"])
    assert {"payload", "name"}.isdisjoint(narrow.columns) and {"counts", "_others"} < set(narrow.columns)
    out = policy.decide(events, P)
    got = {r.seq: r for r in out.collect()}
    assert all(r.payload.a == r.seq and r.counts == {r.kind: r.seq} and r.name == f"m{r.seq}" for r in got.values())
    plain = {r.seq: r for r in policy.decide(spark.createDataFrame(rows, SCHEMA), P).collect()}
    assert len(got) == len(plain) == len(rows) and all(got[k][c] == plain[k][c] for k in plain for c in OUT)
    plan = [re.sub(r"#\d+L?", "", x).strip(" :+-") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    shuffled = [plan[i + 1] for i, x in enumerate(plan) if x.startswith("RepartitionByExpression [chat_id, intent, _piece]")]
    assert len(shuffled) == 2 and len(set(shuffled)) == 1 and "payload" in shuffled[0]
