"""Text -> expected value, one table per extractor, traps included."""

import pytest
from pyspark.sql import functions as F

from chatsift.functions import targeting as G
from chatsift.functions import text as X
from chatsift.functions.timephrase import with_time_phrase

def T():
    return F.col("text")


CASES = {
    "amount": (X.extract_amount, [
        ("pay me back the 50$", "$50"), ("shall I send the remaining $30?", "$30"),
        ("split the uber 30 bucks each", "30 bucks"), ("split 2 $20 pizzas", "$2"),
        ("pay 1,000$", "$000"), ("no numbers here", None), ("you owe me $1,250.75 now", "$1,250.75"),
        ("50 $ please", "$50"), ("20 Dollars", "20 Dollars"),
    ]),
    "phone": (X.extract_phone, [
        ("here's my number 9876543210", "+91 98765 43210"), ("call +91-98765-43210", "+91 98765 43210"),
        ("(415) 555-1234", "+1 415 555 1234"), ("1-415-555-1234", "+1 415 555 1234"),
        ("6505551234", "+91 65055 51234"), ("order # 9876543210", None), ("none", None),
        ("hey akash save this number +1 415-555-1234", "+1 415 555 1234"),
        ("415.555.1234", "+1 415 555 1234"), ("9198765432", "+91 91987 65432"),
        ("across the border 9876543210", None),
        ("my old ticket, " + "x" * 40 + " 9876543210", "+91 98765 43210"),
    ]),
    "duration": (X.duration_seconds, [
        ("ping me in 20 min", 1200), ("in 2 hours", 7200), ("in 1 minute", None), ("IN 3 HRS", 10800),
        ("in 99999999999999999999 hours", None),
    ]),
    "place": (X.extract_place, [
        ("meet me at blue bottle on valencia", "blue bottle on valencia"),
        ("lets eat at chipotle tomorrow", "chipotle"), ("dolores park!", "dolores park"),
        ("open whole foods in maps", "whole foods in maps"), ("heading to dolores park", "dolores park"),
        ("I'm at  ", "I'm at"), ("I'm at .", ""), ("!!", None), ("see you there, from work", "work"),
        ("at home\nsee you at noon", "noon"),
    ]),
    "addressee": (G.addressee, [
        ("priya: save this", "priya"), ("hey yo akash", None), ("hey akash save", "akash"), ("@mike hi", "mike"),
        ("bob, hi", None), ("your move sarah", None), ("John, hello", "john"),
    ]),
    "self": (G.is_self, [("note to self buy milk", True), ("remind me to", True), ("nothing", False)]),
    "mutual": (G.is_mutual, [
        ("y'all coming", True), ("team sync friday", True), ("call the plumber", False), ("We're here", True),
        ("all  of us", True), ("tweak", False),
    ]),
    "trigger": (X.trigger_type, [
        ("I'll venmo you $20", "payment_app"), ("let's split dinner 3 ways", "bill_splitting"),
        ("nice flower", "owing_debt"), ("that is $5", "direct_amount"), ("my treat", "general_money"),
        ("on behalf of", "bill_splitting"),
    ]),
    "direction": (X.direction, [
        ("I'll venmo you $20", "offer"), ("do I owe you anything?", "offer"), ("you owe me $25", "request"),
        ("let's split dinner 3 ways", "split"), ("teach me", "split"), ("whatever", "request"),
    ]),
    "valid_time": (X.valid_time_phrase, [
        ("me", False), ("8p", False), ("8pm", True), ("tomorrow", True), ("monday", True), ("sunny", False),
        ("set alarm", False),
    ]),
    "blank": (X.is_blank, [("", True), ("   ", True), (" \n", True), ("a", False), (None, True)]),
}


@pytest.mark.parametrize("name", CASES)
def test_extractor(spark, name):
    fn, cases = CASES[name]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    got = {r["i"]: r["v"] for r in rows.select("i", fn(T()).alias("v")).collect()}
    assert {cases[i][0]: got[i] for i in got} == {text: want for text, want in cases}


def test_third_party(spark):
    cases = [
        ("tell sarah and mike", None, "akash", "sarah"), ("tell sarah and mike", "sarah", "akash", "mike"),
        ("mom said mike", None, "MOM", "mike"), ("nobody", None, None, None), ("mommy", None, None, None),
    ]
    rows = spark.createDataFrame(cases, "text string, who string, sender string, want string")
    for r in rows.select("*", G.third_party(T(), F.col("who"), F.col("sender")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_strip_phrase_label_title(spark):
    cases = [
        ("dinner friday 8pm friday 8pm", "friday 8pm", "dinner", "dinner", "dinner"),
        ("remind me to take meds at 10pm", "at 10pm", "remind me to take meds", "take meds", "remind me to take meds"),
        ("save the date for may 5 wedding", "may 5", "save the date for wedding", "save the date for wedding", "for wedding"),
        ("hey lunch at", None, "hey lunch at", "hey lunch", "lunch"),
        ("wake me up at 6am", "6am", "wake me up at", None, "wake me up"),
        ("ping me about it in 20 min", None, "ping me about it in 20 min", "ping me about it", "ping me about it in 20 min"),
    ]
    rows = spark.createDataFrame(cases, "text string, p string, stripped string, label string, title string")
    p = F.col("p")
    got = rows.select(
        "*", X.strip_phrase(T(), p).alias("s"), X.alarm_label(T(), p).alias("l"), X.calendar_title(T(), p).alias("t")
    ).collect()
    for r in got:
        assert (r["s"], r["l"], r["t"]) == (r["stripped"], r["label"], r["title"]), r


@pytest.mark.parametrize("text, iso, phrase", [
    # anchored at Wednesday 2024-01-03 10:15:30
    ("remind me to venmo priya $25 at 8pm", "2024-01-03T20:00", "at 8pm"),
    ("meeting at 3pm tomorrow", "2024-01-04T15:00", "at 3pm tomorrow"),
    ("team sync friday 4pm", "2024-01-05T16:00", "friday 4pm"),
    ("wake me at 6:30 am", "2024-01-04T06:30", "at 6:30 am"),
    ("standup wednesday 9am", "2024-01-10T09:00", "wednesday 9am"),
    ("ping me in 20 min", "2024-01-03T10:35", "in 20 min"),
    ("call in 2 weeks", "2024-01-17T10:15", "in 2 weeks"),
    ("dinner 14 june", "2024-06-14T00:00", "14 june"),
    ("flight jan 2 at 20:30", "2025-01-02T20:30", "jan 2 at 20:30"),
    ("party 25/12", "2024-12-25T00:00", "25/12"),
    ("party 3/5/26 noon", "2026-03-05T12:00", "3/5/26 noon"),
    ("tomorrow then", "2024-01-04T10:15", "tomorrow"),
    ("next week maybe", "2024-01-10T10:15", "next week"),
    ("gym this weekend", "2024-01-06T00:00", "this weekend"),
    ("gym next weekend", "2024-01-13T00:00", "next weekend"),
    ("tonight at 8:30 pm", "2024-01-03T20:30", "tonight at 8:30 pm"),
    ("Tomorrow Morning ok", "2024-01-04T09:00", "Tomorrow Morning"),
    ("12am sharp", "2024-01-04T00:00", "12am"),
    ("feb 30 at 9pm", None, None), ("1:1 with bob", None, None), ("me and set", None, None),
])
def test_time_phrase(spark, text, iso, phrase):
    row = spark.createDataFrame([(text,)], "text string").withColumn(
        "ts", F.lit("2024-01-03 10:15:30").cast("timestamp")
    )
    got = with_time_phrase(row, "text", "ts").first()
    assert (got["time_iso"], got["time_phrase"]) == (iso, phrase)


@pytest.mark.parametrize("text", [
    "lunch mar 5\nnoon", "meeting on\n5 mar", "dinner noon\n5 mar", "call\tmar\r\n5 at\n8:30 pm", "5\u2028mar noon", "mar \u0665 noon",
    "in 999999 w\n", "13/13/13\n25:99", "mar 5\u00a0noon\n\n7 apr",
])
def test_time_phrase_survives_any_white_space(spark, text):
    row = spark.createDataFrame([(text,)], "text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    with_time_phrase(row, "text", "ts").collect()


def test_day_before_a_line_break(spark):
    row = spark.createDataFrame([("lunch mar 5\nnoon",)], "text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    got = with_time_phrase(row, "text", "ts").first()
    assert got["time_iso"] and got["time_iso"][5:10] == "03-05"
