"""Ordered conversations with explicit times, and what must come out of them."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from chatsift.config import CONTROLS_SCHEMA, MESSAGES_SCHEMA, PolicyParams
from chatsift.operators import enrich, metrics, respond, state
from chatsift.plans.end_to_end import enrich_and_decide

START = datetime.datetime(2024, 1, 3, 10, 0, 0)
OWE = "you owe me $40"
BOTH = "remind me to pay priya at 8pm $25"

# name -> [(seconds, chat, text or control, ...)]; controls are (kind, intent, amount)
SCENARIOS = {
    "first": [(0, "a", "yo you still owe me $40 from the airbnb")],
    "nags": [(0, "a", OWE), (5, "a", "fr pay up lol"), (6, "a", "bro pay me back now"), (7, "a", "venmo me whenever")],
    "chatter": [(0, "a", OWE), (5, "a", "yeah yeah my bad lemme grab my phone")],
    "override": [(0, "a", OWE), (30, "a", "oh also you owe me $15 for gas")],
    "same": [(0, "a", OWE), (30, "a", "bro the $40 pls")],
    "expired": [(0, "a", OWE), (310, "a", "pay up")],
    "paid": [(0, "a", OWE), (1, "a", ("payment_complete", None, "$40")), (2, "a", "sent!"), (3, "a", "paid you back $40 bro")],
    "grace_over": [(0, "a", OWE), (1, "a", ("payment_complete", None, "$40")), (66, "a", "also you owe me $15 for gas")],
    "dismissed": [(0, "a", OWE), (1, "a", ("popup_dismissed", None, None)), (2, "a", "bro the money")],
    "dismissed_long": [(0, "a", OWE), (1, "a", ("popup_dismissed", None, None)), (331, "a", "pay me")],
    "isolated": [(0, "a", OWE), (1, "b", "hey split ubers this weekend?")],
    "untracked": [(0, None, OWE), (1, "", OWE), (2, None, "nothing here")],
    "reset": [(0, "a", OWE), (1, "a", ("reset_cooldown", None, None)), (2, "a", "you owe me $40 bro")],
    "counters": [(0, "a", OWE), (1, "a", "pay up bro"), (2, "a", "venmo me fr"), (3, "a", "meeting tomorrow at noon"),
                 (4, "b", "hey split ubers?")],
    "evicted": [(0, "old", OWE), (1855, "new", "you owe me $50"), (1860, "new", "random non-money")],
    "paid_unknown": [(0, "a", ("payment_complete", None, "$20"))],
    "trace": [(0, "a", "yo you still owe me $40 from the airbnb"), (1, "a", "fr pay up"), (2, "a", "bro it's been 2 weeks"),
              (3, "a", "venmo me whenever"), (4, "a", "yeah yeah my bad lemme grab my phone"),
              (5, "a", ("payment_complete", None, "$40")), (6, "a", "sent!"), (7, "a", "got it thanks bro"),
              (2705, "a", "oh also u owe me $15 for gas"), (2706, "a", ("popup_dismissed", None, None)),
              (2707, "a", "bro the gas money")],
    "per_intent": [(0, "a", "remind me to take meds at 10pm"), (1, "a", "btw you owe me $40 for groceries")],
    "multi": [(0, "a", "remind me to venmo priya $25 at 8pm")],
    "paid_scoped": [(0, "a", BOTH), (1, "a", ("payment_complete", None, "$25"))],
    "dismiss_scoped": [(0, "a", BOTH), (1, "a", ("popup_dismissed", "alarm", None)), (2, "a", ("popup_dismissed", "bogus", None))],
    "reset_scoped": [(0, "a", BOTH), (1, "a", ("reset_cooldown", "money", None)), (2, "a", ("reset_cooldown", None, None))],
    "targeting": [(0, "a", "remind me to call mom"), (1, "b", "team sync friday 4pm")],
    "maps": [(0, "a", "heading to dolores park")],
    "alarm_override": [(0, "a", "remind me at 10pm to take meds"), (30, "a", "actually remind me at 11pm instead")],
    "contact": [(0, "a", "hey akash save this number +1 415-555-1234")],
    "calendar": [(0, "a", "meeting at 3pm tomorrow"), (1, "a", "meeting at 3pm tomorrow")],
    # window edges
    "at_300": [(0, "a", OWE), (300, "a", OWE)], "at_299": [(0, "a", OWE), (299, "a", OWE)],
    "dis_899": [(0, "a", ("popup_dismissed", None, None)), (899, "a", OWE)],
    "dis_900": [(0, "a", ("popup_dismissed", None, None)), (900, "a", OWE)],
    "grace_59": [(0, "a", ("payment_complete", None, None)), (59, "a", OWE)],
    "grace_60": [(0, "a", ("payment_complete", None, None)), (60, "a", OWE)],
    "idle_1800": [(0, "a", OWE), (1800, "a", OWE)], "idle_1801": [(0, "a", OWE), (1801, "a", OWE)],
    "no_prolong": [(0, "a", OWE), (290, "a", OWE), (301, "a", OWE)],
    "null_amount": [(0, "a", "pay up"), (10, "a", "you owe me $15")],
    "dis_fresh": [(0, "a", ("popup_dismissed", None, None)), (10, "a", OWE)],
    "dis_override": [(0, "a", OWE), (1, "a", ("popup_dismissed", None, None)), (30, "a", "you owe me $15")],
    "grace_amount": [(0, "a", OWE), (1, "a", ("payment_complete", None, "$40")), (5, "a", "you owe me $15")],
    "same_ts": [(0, "a", OWE), (0, "a", "you owe me $15"), (0, "a", "you owe me $15")],
}


def tables(spark, scenarios):
    msgs, ctls, seq = [], [], 0
    for name, events in scenarios.items():
        for after, chat, what in events:
            seq += 1
            ts = START + datetime.timedelta(seconds=after)
            chat = f"{name}:{chat}" if chat else chat
            if isinstance(what, str):
                msgs.append((seq, ts, f"{name}/{seq}", chat, "akash", what))
            else:
                ctls.append((seq, ts, chat, what[0], what[1], what[2], None, None, None))
    return spark.createDataFrame(msgs, MESSAGES_SCHEMA), spark.createDataFrame(ctls, CONTROLS_SCHEMA)


@pytest.fixture(scope="module")
def world(spark):
    msgs, ctls = tables(spark, SCENARIOS)
    d = enrich_and_decide(msgs, ctls).persist()
    yield msgs, ctls, d
    d.unpersist()


@pytest.fixture(scope="module")
def rows(world):
    out = {name: [] for name in SCENARIOS}
    seqs, seq = {}, 0
    for name, events in SCENARIOS.items():
        for _ in events:
            seq += 1
            seqs[seq] = name
    for r in sorted(world[2].collect(), key=lambda r: (r["seq"], r["intent"])):
        out[seqs[r["seq"]]].append(r)
    return out


def verdicts(rows, intent="money"):
    return [r["suppressed_reason"] or "fire" for r in rows if r["kind"] == "message" and r["intent"] == intent]


@pytest.mark.parametrize("name, intent, want", [
    ("first", "money", ["fire"]),
    ("nags", "money", ["fire"] + ["cooldown_active"] * 3),
    ("chatter", "money", ["fire"]),
    ("override", "money", ["fire", "fire"]),
    ("same", "money", ["fire", "cooldown_active"]),
    ("expired", "money", ["fire", "fire"]),
    ("paid", "money", ["fire", "post_payment_grace"]),
    ("grace_over", "money", ["fire", "fire"]),
    ("dismissed", "money", ["fire", "recently_dismissed"]),
    ("dismissed_long", "money", ["fire", "recently_dismissed"]),
    ("isolated", "money", ["fire", "fire"]),
    ("untracked", "money", ["fire", "fire"]),
    ("reset", "money", ["fire", "fire"]),
    ("counters", "money", ["fire", "cooldown_active", "cooldown_active", "fire"]),
    ("counters", "calendar", ["fire"]),
    ("trace", "money", ["fire", "cooldown_active", "cooldown_active", "fire", "recently_dismissed"]),
    ("per_intent", "alarm", ["fire"]), ("per_intent", "money", ["fire"]),
    ("multi", "money", ["fire"]), ("multi", "alarm", ["fire"]),
    ("maps", "maps", ["fire"]), ("contact", "contact", ["fire"]),
    ("alarm_override", "alarm", ["fire", "fire"]),
    ("calendar", "calendar", ["fire", "cooldown_active"]),
    ("at_300", "money", ["fire", "fire"]), ("at_299", "money", ["fire", "cooldown_active"]),
    ("dis_899", "money", ["recently_dismissed"]), ("dis_900", "money", ["fire"]),
    ("grace_59", "money", ["post_payment_grace"]), ("grace_60", "money", ["fire"]),
    ("idle_1800", "money", ["fire", "fire"]), ("idle_1801", "money", ["fire", "fire"]),
    ("no_prolong", "money", ["fire", "cooldown_active", "fire"]),
    ("null_amount", "money", ["fire", "cooldown_active"]),
    ("dis_fresh", "money", ["recently_dismissed"]),
    ("dis_override", "money", ["fire", "fire"]),
    ("grace_amount", "money", ["fire", "post_payment_grace"]),
    ("same_ts", "money", ["fire", "fire", "cooldown_active"]),
])
def test_verdicts(rows, name, intent, want):
    assert verdicts(rows[name], intent) == want


def test_details(rows):
    first = rows["first"][0]
    assert (first["chat_state"], first["popup_count"], first["payload"]["amount"]) == ("cooldown", 1, "$40")
    assert (first["payload"]["direction"], first["payload"]["trigger_type"]) == ("request", "owing_debt")
    nag = rows["nags"][-1]
    assert (nag["popup_count"], nag["suppression_count"]) == (1, 3) and nag["cooldown_remaining_seconds"] > 0
    assert rows["at_299"][1]["cooldown_remaining_seconds"] == 1
    assert rows["dismissed"][-1]["cooldown_remaining_seconds"] > 300
    assert rows["override"][1]["popup_count"] == 2
    assert json.loads(rows["override"][1]["last_payload"])["amount"] == "$15"
    assert rows["isolated"][1]["payload"]["trigger_type"] == "bill_splitting"
    assert {r["chat_state"] for r in rows["untracked"]} == {"untracked"}
    assert [rows[n][1]["popup_count"] for n in ("idle_1800", "idle_1801")] == [2, 1]
    observed = rows["chatter"][1]
    assert (observed["kind"], observed["chat_state"], observed["popup_count"]) == ("observe", "cooldown", 1)
    alarm = [r for r in rows["multi"] if r["intent"] == "alarm"][0]
    assert alarm["payload"]["time_iso"] == "2024-01-03T20:00"
    own, group = rows["targeting"][0]["targeting"], [r for r in rows["targeting"] if r["intent"] == "calendar"][0]["targeting"]
    assert (own["is_self"], own["third_party"], own["is_mutual"]) == (True, "mom", False)
    assert (group["is_self"], group["is_mutual"]) == (False, True)
    contact = [r for r in rows["contact"] if r["intent"] == "contact"][0]
    assert contact["payload"]["phone"] == "+1 415 555 1234" and contact["targeting"]["addressee"] == "akash"
    assert "dolores" in [r for r in rows["maps"] if r["intent"] == "maps"][0]["payload"]["place"]


def test_controls(world, rows):
    answers = {(r["chat_id"], r["kind"], r["intent"]): r for r in state.control_results(world[2]).collect()}
    paid = answers["paid:a", "payment_complete", "money"]
    assert (paid["previous_state"], paid["chat_state"], paid["grace_window_seconds"]) == ("cooldown", "post_payment", 60)
    assert paid["popup_count_total"] == 1
    assert answers["paid_unknown:a", "payment_complete", "money"]["previous_state"] == "idle"
    gone = answers["dismissed:a", "popup_dismissed", "money"]
    assert (gone["chat_state"], gone["cooldown_seconds"]) == ("dismissed", 900)
    assert answers["reset_scoped:a", "reset_cooldown", "money"]["existed"] is True
    cleared = {r["chat_id"]: r["cleared_intents"] for r in state.cleared_intents(world[2]).collect()}
    assert cleared == {"reset:a": ["money"], "reset_scoped:a": ["alarm"]}
    bad = enrich.reject_controls(world[1]).collect()
    assert [(r["chat_id"], r["reason"]) for r in bad] == [("dismiss_scoped:a", "unknown intent")]


def test_snapshot(spark, world):
    as_of = F.lit((START + datetime.timedelta(seconds=1865)).isoformat()).cast("timestamp")
    snap = {(r["chat_id"], r["intent"]): r for r in state.snapshot(world[2], as_of).collect()}
    assert ("evicted:old", "money") not in snap and ("evicted:new", "money") in snap
    new = snap["evicted:new", "money"]
    assert (new["cooldown_remaining_seconds"], new["popup_count"], new["last_popup_at"]) == (290, 1, "2024-01-03T10:30:55")
    early = F.lit((START + datetime.timedelta(seconds=10)).isoformat()).cast("timestamp")
    live = state.snapshot(world[2], early).persist()
    by = {(r["chat_id"], r["intent"]): r["state"] for r in live.collect()}
    assert (by["paid_scoped:a", "money"], by["paid_scoped:a", "alarm"]) == ("post_payment", "cooldown")
    assert (by["dismiss_scoped:a", "money"], by["dismiss_scoped:a", "alarm"]) == ("cooldown", "dismissed")
    assert not [k for k in by if k[0] == "reset_scoped:a"]
    asked = spark.createDataFrame([("nobody",), ("first:a",)], "chat_id string")
    got = {r["chat_id"]: r for r in state.chat_states(asked, live).collect()}
    assert got["nobody"]["state"] == "idle" and "no tracker entries" in got["nobody"]["message"]
    assert got["first:a"]["intents"]["money"]["popup_count"] == 1 and got["first:a"]["state"] is None


def test_counters(spark):
    msgs, _ = tables(spark, {"counters": SCENARIOS["counters"], "untracked": SCENARIOS["untracked"]})
    d = enrich_and_decide(msgs).persist()
    m = metrics.service_metrics(d).first()
    # untracked messages count as requests and detections, never as popups
    assert (m["requests"], m["money_detected"], m["popups_fired"], m["popups_suppressed"]) == (8, 6, 3, 2)
    assert (m["detection_rate"], m["suppression_rate"]) == (0.75, 0.4)
    counts = {r["intent"]: r["detected"] for r in metrics.intent_counts(d).collect()}
    assert counts == {"money": 6, "alarm": 0, "contact": 0, "calendar": 1, "maps": 0}
    as_of = F.lit((START + datetime.timedelta(seconds=10)).isoformat()).cast("timestamp")
    assert metrics.active_trackers(state.snapshot(d, as_of)).first()[0] == 3


def test_replies(world):
    got = {r["message_id"]: r for r in respond.replies(world[2]).collect()}
    by = lambda name: [got[k] for k in sorted(got, key=lambda k: int(k.split("/")[1])) if k.startswith(name + "/")]
    quiet = by("chatter")[1]
    assert quiet["intents"] == [] and (quiet["is_money"], quiet["suppressed_reason"]) == (False, "not_money")
    assert (quiet["chat_state"], quiet["confidence"], quiet["should_popup"]) == ("cooldown", 0.01, False)
    multi = by("multi")[0]
    assert [x["type"] for x in multi["intents"]] == ["money", "alarm"]
    assert (multi["is_money"], multi["detected_amount"], multi["should_popup"]) == (True, "$25", True)
    assert by("calendar")[1]["is_money"] is False
    assert by("untracked")[2]["chat_state"] == "untracked"


def test_blank_messages_are_rejected(spark):
    msgs, _ = tables(spark, {"x": [(0, "a", ""), (1, "a", "   "), (2, "a", "hi")]})
    assert enrich.reject_messages(msgs).count() == 2 and enrich.accept_messages(msgs).count() == 1


def test_threshold_is_a_parameter(spark):
    msgs, _ = tables(spark, {"x": [(0, "a", OWE)]})
    assert enrich.fired_intents(msgs, PolicyParams(threshold=0.99)).count() == 1
    assert enrich.fired_intents(msgs, PolicyParams(threshold=0.995)).count() == 0
