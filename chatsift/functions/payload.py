"""Per-intent payloads: one nullable superset struct, JSON text, override keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.functions import text as X
from chatsift.functions.targeting import addressee

PAYLOAD_TYPE = (
    "struct<amount:string,trigger_type:string,direction:string,label:string,"
    "time_iso:string,time_phrase:string,seconds_from_now:bigint,phone:string,"
    "name_hint:string,title:string,start_iso:string,start_phrase:string,"
    "duration_minutes:int,place:string>"
)

# Payload fields whose change makes a repeated intent count as a new action.
OVERRIDE_KEYS = {
    "money": ["amount"],
    "alarm": ["time_iso", "seconds_from_now"],
    "contact": ["phone"],
    "calendar": ["start_iso"],
    "maps": ["place"],
}

# (always present, present only when set) fields of each intent's payload
JSON_FIELDS = {
    "money": (["amount", "trigger_type", "direction"], []),
    "alarm": (["label"], ["time_iso", "time_phrase", "seconds_from_now"]),
    "contact": (["phone", "name_hint"], []),
    "calendar": (["title"], ["start_iso", "start_phrase", "duration_minutes"]),
    "maps": (["place"], []),
}


def with_payload(df: DataFrame) -> DataFrame:
    """Add ``payload`` to rows of (intent, fired, text, time_iso, time_phrase).

    Each extractor reads a copy of the text that is null unless its intent
    fired. Null texts cost nothing, and no pattern sits in a conditional branch
    where Spark could not share it.
    """
    c = F.col

    def only(intent: str, name: str) -> Column:
        return F.when(c("fired") & (c("intent") == intent), c(name))

    df = df.withColumns({
        "_money": only("money", "text"), "_alarm": only("alarm", "text"),
        "_contact": only("contact", "text"), "_calendar": only("calendar", "text"),
        "_maps": X.strip_space(only("maps", "text")),
    })
    low = c("_low") if "_low" in df.columns else F.lower("text")
    df = df.withColumn("_money_low", F.when(c("_money").isNotNull(), low))
    is_money, is_calendar = c("_money").isNotNull(), c("_calendar").isNotNull()
    fields = {
        "amount": X.extract_amount(c("_money")),
        "trigger_type": F.when(is_money, X.trigger_type(c("_money"), c("_money_low"))),
        "direction": F.when(is_money, X.direction(c("_money"), c("_money_low"))),
        "label": X.alarm_label(c("_alarm"), c("time_phrase")),
        "time_iso": F.when(c("_alarm").isNotNull(), c("time_iso")),
        "time_phrase": F.when(c("_alarm").isNotNull(), c("time_phrase")),
        "seconds_from_now": X.duration_seconds(c("_alarm")),
        "phone": X.extract_phone(c("_contact")),
        "name_hint": addressee(c("_contact")),
        "title": X.calendar_title(c("_calendar"), c("time_phrase")),
        "start_iso": F.when(is_calendar, c("time_iso")),
        "start_phrase": F.when(is_calendar, c("time_phrase")),
        "duration_minutes": F.when(is_calendar & c("time_iso").isNotNull(), X.event_minutes(c("_calendar"))),
        "place": X.place_of(c("_maps")),
    }
    body = F.struct(*[v.alias(k) for k, v in fields.items()])
    return df.withColumn("payload", F.when(c("fired"), body)).drop(
        "_money", "_money_low", "_alarm", "_contact", "_calendar", "_maps"
    )


def payload_json(intent: Column, payload: Column) -> Column:
    """JSON text of a payload, keeping "present but null" apart from "absent"."""
    out = None
    for name, (always, optional) in JSON_FIELDS.items():
        base = F.to_json(
            F.struct(*[payload[f].alias(f) for f in always]), {"ignoreNullFields": "false"}
        )
        if optional:
            extra = F.to_json(F.struct(*[payload[f].alias(f) for f in optional]))
            base = F.when(extra == "{}", base).otherwise(
                F.concat(F.left(base, F.length(base) - 1), F.lit(","), F.substr(extra, F.lit(2)))
            )
        out = F.when(intent == name, base) if out is None else out.when(intent == name, base)
    return out.otherwise(F.lit("{}"))


def override_key(intent: Column, payload: Column, slot: int, keys: dict | None = None) -> Column:
    """The slot-th override value as text; '' and 0 count as not set."""
    out = F.lit(None).cast("string")
    for name, fields in (OVERRIDE_KEYS if keys is None else keys).items():
        if slot < len(fields):
            value = payload[fields[slot]].cast("string")
            if fields[slot] in ("seconds_from_now", "duration_minutes"):
                value = F.nullif(value, F.lit("0"))
            out = F.when(intent == name, F.nullif(value, F.lit(""))).otherwise(out)
    return out


def override_key_of_json(intent: Column, body: Column, slot: int, keys: dict | None = None) -> Column:
    """The same value read from a payload's JSON text."""
    out = F.lit(None).cast("string")
    for name, fields in (OVERRIDE_KEYS if keys is None else keys).items():
        if slot < len(fields):
            value = F.get_json_object(body, f"$.{fields[slot]}")
            if fields[slot] in ("seconds_from_now", "duration_minutes"):
                value = F.nullif(value, F.lit("0"))
            out = F.when(intent == name, F.nullif(value, F.lit(""))).otherwise(out)
    return out
