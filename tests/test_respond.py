"""Links, cards, audiences, summaries, frames."""

import datetime
import json

from pyspark.sql import functions as F

from chatsift.config import MESSAGES_SCHEMA
from chatsift.functions import links as L
from chatsift.operators import enrich, respond
from chatsift.plans.end_to_end import enrich_and_decide
from chatsift.sources import messages as S

START = datetime.datetime(2024, 1, 3, 10, 0, 0)


def messages(spark, texts, sender="akash"):
    rows = [(i, START + datetime.timedelta(seconds=30 * i), f"m{i}", f"c{i}", sender, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, MESSAGES_SCHEMA)


def test_cards(spark):
    texts = [
        "remind me to venmo priya $25 at 8pm", "hey sarah save this number +1 415-555-1234", "team sync friday 4pm & 'more'",
        "heading to joe's & co!", "pay up", "save this number",
    ]
    cards = respond.action_cards(enrich.fired_intents(messages(spark, texts)))
    got = {(r["seq"], r["intent"]): r for r in cards.collect()}
    money = got[0, "money"]
    assert money["link"] == "https://venmo.com/?txn=pay&amount=25&recipients=priya"
    assert money["title"] == "Send $25 to priya" and money["confidence"] == "99%"
    assert got[0, "alarm"]["subtitle"] == "at 8pm" and got[0, "alarm"]["link"] is None
    assert got[1, "contact"]["link"] == "tel:+1 415 555 1234" and got[1, "contact"]["title"] == "Save sarah"
    calendar = got[2, "calendar"]
    assert calendar["link"].endswith("?text=team%20sync%20%26%20'more'&dates=20240105T160000Z/20240105T163000Z")
    assert calendar["title"] == "team sync &amp; &#39;more&#39;"
    assert got[3, "maps"]["link"].endswith("query=joe's%20%26%20co")
    assert got[4, "money"]["title"] == "Send — " and got[4, "money"]["link"] == "https://venmo.com/?txn=pay"
    assert got[5, "contact"]["title"] == "Save New contact"
    assert [r["intent"] for r in respond.summary_cards(cards.where("seq = 0")).collect()] == ["money", "alarm"]


def test_small_formats(spark):
    row = spark.range(1).select(
        L.minutes_seconds(F.lit(65.9)).alias("a"), L.minutes_seconds(F.lit(5)).alias("b"),
        L.iso_utc(F.lit(1704276000000000)).alias("c"), L.iso_utc(F.lit(1704276000000120)).alias("d"),
        L.escape_html(F.lit("""<a href="x">'&'</a>""")).alias("e"), L.percent_encode(F.lit("a b+c/ü~(!)")).alias("f"),
    ).first()
    assert (row["a"], row["b"]) == ("1:05", "0:05")
    assert (row["c"], row["d"]) == ("2024-01-03T10:00:00", "2024-01-03T10:00:00.000120")
    assert row["e"] == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"
    assert row["f"] == "a%20b%2Bc%2F%C3%BC~(!)"


def test_audience(spark):
    texts = ["you owe me $25", "I'll venmo you $20", "let's split dinner 3 ways", "remind me to call mom",
             "team sync friday 4pm", "hey priya lunch at noon", "lunch at noon"]
    d = enrich_and_decide(messages(spark, texts))
    members = spark.createDataFrame([(f"c{i}", u) for i in range(len(texts)) for u in ("akash", "Priya", "mike")],
                                    "chat_id string, user string")
    got = {}
    for r in respond.audience(d, members).collect():
        got.setdefault((r["seq"], r["intent"]), set()).add(r["user"])
    assert got[0, "money"] == {"Priya", "mike"} and got[1, "money"] == {"akash"}
    assert got[2, "money"] == {"akash", "Priya", "mike"} and got[3, "alarm"] == {"akash"}
    assert got[4, "calendar"] == {"akash", "Priya", "mike"} and got[5, "calendar"] == {"Priya"}
    assert (6, "calendar") not in got


def test_call_summary(spark):
    rows = [(i, START + datetime.timedelta(seconds=s), f"m{i}", "call", "A", t)
            for i, (s, t) in enumerate([(0, "you owe me $25"), (61.5, "ok"), (125.9, "remind me to call mom")])]
    d = enrich_and_decide(spark.createDataFrame(rows, MESSAGES_SCHEMA))
    r = respond.call_summary(respond.replies(d)).first()
    assert (r["actions"], r["messages"], r["duration"]) == (2, 3, "2:05")
    assert r["title"] == "2 actions to follow up on" and r["stats"] == "3 messages · 2:05 duration"


def test_frames(spark):
    raw = [
        '{"text": "you owe me $40", "chat_id": "w", "sender": "akash", "extra": {"a": [1, null]}}',
        '{"text": "pay up", "chat_id": "w"}', '{"text": "   "}', '{"chat_id": "w"}', "not json", "{}",
    ]
    rows = [(i, START + datetime.timedelta(seconds=i), v) for i, v in enumerate(raw)]
    parsed = S.parse_frames(spark.createDataFrame(rows, "seq bigint, ts timestamp, value string"))
    bad = {r["value"]: json.loads(r["response"]) for r in S.rejected_frames(parsed).collect()}
    assert bad == {"not json": {"error": "invalid JSON"}, '{"text": "   "}': {"error": "text required"},
                   '{"chat_id": "w"}': {"error": "text required"}, "{}": {"error": "text required"}}
    d = enrich_and_decide(S.good_frames(parsed), keep=["value", "confidence", "payload", "targeting", "ordinal"])
    r = respond.replies(d, keep=["value"])
    out = [json.loads(x["response"]) for x in r.orderBy("seq").select(
        respond.frame_response(F.col("value"), F.col("intents")).alias("response")).collect()]
    assert out[0]["extra"] == {"a": [1, None]} and out[0]["chat_id"] == "w"
    flat = out[0]["venmo_detection"]
    assert len(flat) == 10 and (flat["is_money"], flat["should_popup"], flat["chat_state"]) == (True, True, "cooldown")
    assert out[0]["intents"][0]["payload"] == {"amount": "$40", "trigger_type": "owing_debt", "direction": "request"}
    assert out[0]["intents"][0]["targeting"] == {
        "addressee": None, "third_party": None, "is_self": False, "is_mutual": False}
    assert out[1]["venmo_detection"]["suppressed_reason"] == "cooldown_active"


def test_payload_json_null_or_absent(spark):
    from chatsift.functions.payload import payload_json

    texts = ["remind me", "remind me to go in 20 min", "meeting", "this is new"]
    got = {(r["seq"], r["intent"]): json.loads(r["j"]) for r in enrich.fired_intents(messages(spark, texts)).select(
        "seq", "intent", payload_json(F.col("intent"), F.col("payload")).alias("j")).collect()}
    assert got[0, "alarm"] == {"label": "remind me"}
    assert got[1, "alarm"] == {"label": "go", "time_iso": "2024-01-03T10:20", "time_phrase": "in 20 min", "seconds_from_now": 1200}
    assert got[2, "calendar"] == {"title": "meeting"}
    assert got[3, "contact"] == {"phone": None, "name_hint": None}


def test_cards_are_made_once_for_the_sort(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    cards = spark.range(200).selectExpr("id AS seq", "concat('c', id % 3) AS chat_id", "cast(id % 5 AS int) AS priority")
    got = respond.summary_cards(cards.mapInPandas(count, cards.schema)).collect()
    assert [tuple(r) for r in got] == sorted([tuple(r) for r in got], key=lambda r: (r[1], r[2], r[0])) and len(got) == 200
    assert made.value == 200


def test_replies_meet_in_one_shuffle(spark):
    """A message's rows are sorted once, where they meet; rows that come twice give both entries."""
    texts = ["remind me to venmo priya $25 at 8pm", "nothing here", "pay up"]
    d = enrich_and_decide(messages(spark, texts))
    plan = respond.replies(d)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("hashpartitioning(seq") == 1
    got = {r.seq: r for r in respond.replies(d).collect()}
    assert [e.type for e in got[0].intents] == ["money", "alarm"] and got[0].detected_amount == "$25"
    assert got[1].intents == [] and not got[1].is_money and got[1].suppressed_reason == "not_money"
    assert {k: len(r.intents) for k, r in got.items()} == {0: 2, 1: 0, 2: 1}
    assert {r.seq: len(r.intents) for r in respond.replies(d.union(d)).collect()} == {0: 4, 1: 0, 2: 2}
