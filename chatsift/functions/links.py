"""Action links and display fields of a fired intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsift.functions import vocab as V

NONE = "—"


def percent_encode(value: Column) -> Column:
    """Percent-encoding as browsers do it: %20 for space, ! ' ( ) * ~ kept."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _set(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def recipient(targeting: Column) -> Column:
    return F.coalesce(_set(targeting["third_party"]), _set(targeting["addressee"]))


def payment_link(payload: Column, targeting: Column) -> Column:
    amount, to = _set(payload["amount"]), recipient(targeting)
    return F.concat(
        F.lit(V.PAY_URL),
        F.coalesce(F.concat(F.lit("&amount="), percent_encode(F.regexp_replace(amount, r"^\$", ""))), F.lit("")),
        F.coalesce(F.concat(F.lit("&recipients="), percent_encode(to)), F.lit("")),
    )


def calendar_link(payload: Column) -> Column:
    start = F.try_to_timestamp(payload["start_iso"], F.lit("yyyy-MM-dd'T'HH:mm"))
    minutes = F.coalesce(F.nullif(payload["duration_minutes"], F.lit(0)), F.lit(30))
    end = F.timestamp_micros(F.unix_micros(start) + minutes.cast("bigint") * 60000000)
    stamp = "yyyyMMdd'T'HHmmss'Z'"
    dates = F.concat(F.lit("&dates="), F.date_format(start, stamp), F.lit("/"), F.date_format(end, stamp))
    title = F.coalesce(_set(payload["title"]), F.lit("Event"))
    return F.concat(F.lit(V.CALENDAR_URL + "?text="), percent_encode(title), F.coalesce(dates, F.lit("")))


def maps_link(payload: Column) -> Column:
    return F.concat(F.lit(V.MAPS_URL), percent_encode(F.coalesce(_set(payload["place"]), F.lit(NONE))))


def contact_link(payload: Column) -> Column:
    return F.concat(F.lit("tel:"), F.coalesce(_set(payload["phone"]), F.lit(NONE)))


def contact_name(payload: Column, targeting: Column) -> Column:
    return F.coalesce(_set(payload["name_hint"]), recipient(targeting), F.lit("New contact"))


def action_link(intent: Column, payload: Column, targeting: Column) -> Column:
    """The link a card opens; alarms have none."""
    return (
        F.when(intent == "money", payment_link(payload, targeting))
        .when(intent == "contact", contact_link(payload))
        .when(intent == "calendar", calendar_link(payload))
        .when(intent == "maps", maps_link(payload))
    )


def card_title(intent: Column, payload: Column, targeting: Column) -> Column:
    """Heading of a card, with the defaults for missing values (not escaped)."""
    to = recipient(targeting)
    note = F.coalesce(F.concat(F.lit("to "), to), F.lit(""))
    return (
        F.when(intent == "money", F.concat(
            F.lit("Send "), F.coalesce(_set(payload["amount"]), F.lit(NONE)), F.lit(" "), note))
        .when(intent == "alarm", F.concat(
            F.lit("Set alarm: "), F.coalesce(_set(payload["label"]), F.lit("Reminder"))))
        .when(intent == "contact", F.concat(F.lit("Save "), contact_name(payload, targeting)))
        .when(intent == "calendar", F.coalesce(_set(payload["title"]), F.lit("Event")))
        .when(intent == "maps", F.coalesce(_set(payload["place"]), F.lit(NONE)))
        .otherwise(intent)
    )


def card_subtitle(intent: Column, payload: Column, text: Column) -> Column:
    return (
        F.when(intent == "money", F.concat(F.lit('"'), text, F.lit('"')))
        .when(intent == "alarm", F.coalesce(_set(payload["time_phrase"]), payload["time_iso"], F.lit(NONE)))
        .when(intent == "contact", F.coalesce(_set(payload["phone"]), F.lit(NONE)))
        .when(intent == "calendar", F.coalesce(_set(payload["start_phrase"]), payload["start_iso"], F.lit(NONE)))
        .when(intent == "maps", F.lit("Open in maps"))
        .otherwise(text)
    )


def percent(confidence: Column) -> Column:
    return F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))


def escape_html(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.concat(
        F.floor(whole / 60).cast("bigint").cast("string"), F.lit(":"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
    )


def iso_utc(micros: Column) -> Column:
    """ISO text of an epoch in microseconds: fraction only when there is one."""
    whole = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1000000))
    return F.when(part == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.lpad(part.cast("string"), 6, "0"))
    )
