"""Date and time phrases: a bounded English grammar, anchored on event time.

Meanings (all relative to the message's own timestamp, future preferred):

==================  ========================================================
in N unit           timestamp + N minutes / hours / days / weeks
8pm, 8:30 pm, 20:30 today at that time, tomorrow if that is not in the future
noon, midnight      12:00, 00:00
morning, afternoon, 09:00, 15:00, 18:00, 20:00
evening, tonight
today, tomorrow     that day; without a time the message's own time of day
monday, this/next   next such weekday strictly after the message's day, 00:00
monday              unless a time is given
next week           timestamp + 7 days
this/next weekend   the coming Saturday / the one after it
mar 5, 5 mar, 3/5,  this year, or next year when already past; month first
5/3, 3/5/26         unless the first number is above 12
==================  ========================================================

Results are ISO strings at minute precision. Only the first phrase counts, and
an impossible one (feb 30) yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every piece is plain ASCII regex so that any RE2-style engine reads it alike.
CLOCK = r"(?:1[0-2]|0?[1-9])(?::[0-5]\d)?\s?(?:am|pm)\b|(?:2[0-3]|[01]?\d):[0-5]\d\b"
DAYPART = r"(?:noon|midnight|morning|afternoon|evening|tonight)\b"
WEEKDAY = (
    r"(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    r"mon|tues|tue|wed|thurs|thu|fri|sat|sun)\b"
)
MONTH = (
    r"(?:january|february|march|april|may|june|july|august|september|october|"
    r"november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
)
RELATIVE = r"in\s+\d{1,6}\s*(?:minutes|minute|mins|min|hours|hour|hrs|hr|days|day|weeks|week)\b"
DAY = (
    rf"today\b|tomorrow\b|tmrw\b|tonight\b|(?:this|next)\s+weekend\b|next\s+week\b|"
    rf"(?:(?:this|next)\s+)?{WEEKDAY}|{MONTH}\s+\d{{1,2}}\b|\d{{1,2}}\s+{MONTH}\b|"
    rf"\d{{1,2}}/\d{{1,2}}(?:/(?:\d{{4}}|\d{{2}}))?\b"
)
TIME = rf"{CLOCK}|{DAYPART}"
PHRASE = (
    rf"\b(?:{RELATIVE}"
    rf"|(?:(?:at|on)\s+)?(?:{DAY})(?:\s+(?:at\s+)?(?:{TIME}))?"
    rf"|(?:(?:at|on)\s+)?(?:{TIME})(?:\s+(?:on\s+)?(?:{DAY}))?)"
)
DAYPART_CLOCK = {
    "noon": "12:00", "midnight": "00:00", "morning": "09:00",
    "afternoon": "15:00", "evening": "18:00", "tonight": "20:00",
}
DAYWORD = rf"today|tomorrow|tmrw|tonight|(?:this|next)\s+weekend|next\s+week|{WEEKDAY}"
_STEPS = {
    "_anchored", "_phrase", "_plow", "_rel", "_clock", "_part", "_dayword", "_month", "_mday",
    "_slash", "_hhmm", "_rel_n", "_rel_u", "_s1", "_s2", "_sy", "_weekday", "_today", "_m", "_d",
    "_y", "_date", "_day",
}
MINUTE = "yyyy-MM-dd'T'HH:mm"


def time_phrase(text: Column) -> Column:
    """The first phrase of the grammar; each form passes ``valid_time_phrase``."""
    return F.nullif(F.regexp_extract(text, f"(?i){PHRASE}", 0), F.lit(""))


def _int(digits: Column) -> Column:
    # '' must not reach the cast: a failed try_cast costs an exception per row
    return F.nullif(digits, F.lit("")).cast("int")


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _hour_minute(clock: Column, daypart: Column) -> Column:
    """'HH:mm' of '8:30 pm', '20:30' or a day part; null for neither."""
    hour = _int(F.regexp_extract(clock, r"^\d{1,2}", 0))
    minute = F.coalesce(_int(F.regexp_extract(clock, r":(\d\d)", 1)), F.lit(0))
    hour = (
        F.when(F.endswith(clock, F.lit("pm")), hour % 12 + 12)
        .when(F.endswith(clock, F.lit("am")), hour % 12)
        .otherwise(hour)
    )
    named = F.create_map(*[F.lit(x) for kv in DAYPART_CLOCK.items() for x in kv])
    return F.coalesce(F.concat(_two(hour), F.lit(":"), _two(minute)), F.try_element_at(named, daypart))


def _month_number(name: Column) -> Column:
    months = "janfebmaraprmayjunjulaugsepoctnovdec"
    position = F.instr(F.lit(months), F.substr(name, F.lit(1), F.lit(3)))
    return ((position + 2) / 3).cast("int")


def with_time_phrase(df: DataFrame, text: str, ts: str, when: Column | None = None) -> DataFrame:
    """Add ``time_iso`` and ``time_phrase`` for ``text`` anchored at ``ts``.

    ``when`` limits the work to rows that need it. The steps are separate
    projections on purpose: each regex is evaluated once and reused.
    """
    c = F.col
    df = df.withColumn("_anchored", c(text) if when is None else F.when(when, c(text)))
    df = df.withColumn("_phrase", time_phrase(c("_anchored"))).withColumn("_plow", F.lower("_phrase"))
    month_day = rf"\b{MONTH}\s+(\d{{1,2}})\b|\b(\d{{1,2}})\s+{MONTH}\b"
    df = df.withColumns({
        "_rel": F.regexp_extract("_plow", r"^in\s+(\d{1,6}\s*[mhdw])", 1),
        "_clock": F.regexp_extract("_plow", rf"\b(?:{CLOCK})", 0),
        "_part": F.regexp_extract("_plow", rf"\b{DAYPART}", 0),
        "_dayword": F.regexp_extract("_plow", rf"\b(?:{DAYWORD})", 0),
        "_month": F.regexp_extract("_plow", rf"\b{MONTH}\b", 0),
        # One of the groups is empty. An extract holds digits or nothing, whatever line breaks the phrase has.
        "_mday": F.concat(F.regexp_extract("_plow", month_day, 1), F.regexp_extract("_plow", month_day, 2)),
        "_slash": F.regexp_extract("_plow", r"\b\d{1,2}/\d{1,2}(?:/(?:\d{4}|\d{2}))?\b", 0),
    })
    first, second, third = (
        _int(F.split_part("_slash", F.lit("/"), F.lit(i))) for i in (1, 2, 3)
    )
    df = df.withColumns({
        "_hhmm": _hour_minute(F.nullif("_clock", F.lit("")), c("_part")),
        "_rel_n": _int(F.regexp_extract("_rel", r"^\d+", 0)),
        "_rel_u": F.right("_rel", F.lit(1)),
        "_s1": first, "_s2": second, "_sy": third,
        "_weekday": F.regexp_extract("_dayword", r"(mon|tue|wed|thu|fri|sat|sun)", 1),
        "_today": F.to_date(ts),
    })
    named, swap = c("_month") != "", c("_s1") > 12
    df = df.withColumns({
        "_m": F.when(named, _month_number(c("_month"))).when(swap, c("_s2")).otherwise(c("_s1")),
        "_d": F.when(named, _int(c("_mday"))).when(swap, c("_s1")).otherwise(c("_s2")),
        "_y": F.when(c("_sy") < 100, c("_sy") + 2000).otherwise(c("_sy")),
    })
    df = df.withColumn("_date", _calendar_date(c("_y"), c("_m"), c("_d"), c("_today")))
    df = df.withColumn("_day", (
        F.when(c("_dayword").isin("today", "tonight"), c("_today"))
        .when(c("_dayword").isin("tomorrow", "tmrw"), F.date_add("_today", 1))
        .when(c("_dayword").rlike(r"^this\s+weekend$"), F.next_day("_today", "sat"))
        .when(c("_dayword").rlike(r"^next\s+weekend$"), F.date_add(F.next_day("_today", "sat"), 7))
        .when(c("_dayword").rlike(r"^next\s+week$"), F.date_add("_today", 7))
        .when(c("_weekday") != "", F.expr("next_day(_today, _weekday)"))
        .otherwise(c("_date"))
    ))
    unit_minutes = (
        F.when(c("_rel_u") == "m", 1).when(c("_rel_u") == "h", 60)
        .when(c("_rel_u") == "d", 1440).when(c("_rel_u") == "w", 10080)
    )
    own_clock = F.date_format(ts, "HH:mm")
    keeps_clock = c("_dayword").isin("today", "tomorrow", "tmrw") | c("_dayword").rlike(r"^next\s+week$")
    at = lambda day, hhmm: F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), hhmm)
    later_today = c("_hhmm") > own_clock
    # a day or a date was written, even if it turns out impossible
    has_day = (c("_dayword") != "") | c("_d").isNotNull()
    iso = (
        F.when(c("_rel_n").isNotNull(), F.date_format(
            F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + c("_rel_n").cast("bigint") * unit_minutes * 60000000),
            MINUTE,
        ))
        .when(has_day & c("_hhmm").isNotNull(), at(c("_day"), c("_hhmm")))
        .when(has_day & keeps_clock, at(c("_day"), own_clock))
        .when(has_day, at(c("_day"), F.lit("00:00")))
        .when(c("_hhmm").isNotNull() & later_today, at(c("_today"), c("_hhmm")))
        .when(c("_hhmm").isNotNull(), at(F.date_add("_today", 1), c("_hhmm")))
    )
    df = df.withColumn("time_iso", iso)
    df = df.withColumn("time_phrase", F.when(c("time_iso").isNotNull(), c("_phrase")))
    return df.drop(*[n for n in df.columns if n in _STEPS])


def _calendar_date(year: Column, month: Column, day: Column, today: Column) -> Column:
    def date_in(y: Column) -> Column:
        return F.concat_ws(
            "-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
            F.lpad(day.cast("string"), 2, "0"),
        ).try_cast("date")

    this_year, next_year = date_in(F.year(today)), date_in(F.year(today) + 1)
    known = month.isNotNull() & day.isNotNull()
    return F.when(known & year.isNotNull(), date_in(year)).when(
        known, F.when(this_year < today, next_year).otherwise(this_year)
    )
