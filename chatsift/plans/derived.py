"""Message and control tables derived from the shared test tables.

Every row of ``events`` becomes a message or a control event: the event type
and the number in ``props`` choose the sentence, ``value`` fills it in. A third
of the users write into one chat, some write without a chat. The SQL is plain
enough for any engine, so checks can derive the same rows elsewhere.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.config import PolicyParams
from chatsift.sources.messages import spread

# Windows stretched to the pace of the derived chats, so every rule is met.
PARAMS = PolicyParams(threshold=0.5, cooldown=6000, dismissed=18000, grace=2400, eviction=36000)

# event type -> sentences, picked by k; <v> <d> <h> <k> are filled from the row
_SENTENCES = {
    "purchase": [
        "yo about the boat, you owe me $<v>",
        "venmo me whenever",
        "I'll venmo you <v> bucks for the tickets tomorrow",
        "split the ferry <v>$ each",
        "remind me to venmo priya $<v> at 8pm",
        "shall I send the remaining $<v>.50?",
        "pay up bro",
        "nice flower for <v> dollars, let's  split dinner  3 ways",
    ],
    "view": [
        "team sync friday 4pm",
        "Meeting at 3pm tomorrow",
        "hey guys lunch on mar <d> at noon",
        "schedule a meeting with mike 12/<d> <h>:30 pm",
        "block off next monday <h>am for standup",
        "let's schedule drinks tonight at the harbour bar - ok john",
        "btw coffee this weekend, <d> feb",
        "yeah yeah my bad lemme grab my phone",
    ],
    "click": [
        "heading to the old mill",
        "Meet me at pier <v> tomorrow",
        "omw to the gym on mission",
        "i'm at gate <d>!",
        "open the corner bakery in maps, pull up to the venue",
        "lets eat at the noodle place tomorrow, 1:1 lunch ",
        "navigate to <v> market st, sf",
        "hey sarah the address is <v> main st apt <d>",
    ],
    "signup": [
        "hey akash, save my number: +1 212-555-01<k>",
        "Priya: here's my number 98765432<k>",
        "call me at (415) 555-12<k>",
        "order # 9876543210 this is john",
        "remind me to call mom in <d> min",
        "wake me up at <h>am",
        "Ping me in <h> hours",
        "note to self: take meds at <h>:15 pm everyone",
    ],
    "error": ["   ", "remind me at <h>pm to take meds", None],
}
# error events beyond the sentences above are controls: (slot, kind, intent, amount)
_CONTROLS = [
    (3, "payment_complete", None, "$<v>"),
    (4, "payment_complete", None, None),
    (5, "popup_dismissed", None, None),
    (6, "popup_dismissed", "alarm", None),
    (7, "reset_cooldown", None, None),
    (8, "reset_cooldown", "money", None),
    (9, "popup_dismissed", "bogus", None),
]

_BASE = """
SELECT event_id AS seq, ts, event_type,
       cast(regexp_extract(props, '([0-9]+)', 1) as int)
         % CASE WHEN event_type = 'error' THEN 10 ELSE 8 END AS slot,
       CASE WHEN user_id % 3 = 0 THEN 'chat_hot'
            WHEN user_id % 7 = 1 THEN NULL
            ELSE 'chat_' || cast(user_id % 11 as varchar(9)) END AS chat_id,
       CASE user_id % 6 WHEN 0 THEN 'akash' WHEN 1 THEN 'Priya' WHEN 2 THEN 'mike'
            WHEN 3 THEN 'sarah' WHEN 4 THEN 'john' ELSE NULL END AS sender,
       lpad(regexp_extract(props, '([0-9]+)', 1), 2, '0') AS k,
       cast(cast(floor(value) as bigint) as varchar(20)) AS v,
       cast(cast(floor(value) as bigint) % 28 + 1 as varchar(9)) AS d,
       cast(cast(floor(value) as bigint) % 12 + 1 as varchar(9)) AS h
FROM {events}
"""


def _literal(value) -> str:
    """A SQL literal; quotes go through chr(39), which every engine reads alike."""
    if value is None:
        return "cast(NULL as varchar(99))"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "' || chr(39) || '") + "'"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


def _filled(template: str) -> str:
    for hole in "vdhk":
        template = f"replace({template}, '<{hole}>', b.{hole})"
    return template


def messages_sql(events: str = "events") -> str:
    rows = [(kind, i, s) for kind, texts in _SENTENCES.items() for i, s in enumerate(texts)]
    return f"""
SELECT b.seq, b.ts, 'm' || cast(b.seq as varchar(20)) AS message_id, b.chat_id, b.sender,
       {_filled("t.template")} AS text
FROM ({_BASE.replace("{events}", events)}) b
JOIN {_values(rows, "event_type, slot, template")}
  ON b.event_type = t.event_type AND b.slot = t.slot
"""


def controls_sql(events: str = "events") -> str:
    return f"""
SELECT b.seq, b.ts, b.chat_id, t.kind, t.intent, {_filled("t.amount")} AS amount
FROM ({_BASE.replace("{events}", events)}) b
JOIN {_values(_CONTROLS, "slot, kind, intent, amount")} ON b.slot = t.slot
WHERE b.event_type = 'error' AND b.chat_id IS NOT NULL
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(messages_sql("{events}"), events=spread(events(spark, sf_dir)))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(controls_sql("{events}"), events=events(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as messages."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1_000_000_000 + F.col("turn")).alias("seq"),
        F.col("conv_id").cast("string").alias("chat_id"),
        F.col("role").alias("sender"), "text",
    )
