"""Text extractors as native column expressions (no Python per row)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsift.functions import vocab as V

ALARM_STRIP = " ,.-"
PLACE_STRIP = " ,.-!?"


def rx(pattern: str, ignore_case: bool = False) -> Column:
    """A pattern literal with Unicode classes and '\\n' as the only line end."""
    return F.lit(f"(?{'i' if ignore_case else ''}dU){pattern}")


def literal(needle: str) -> str:
    """The needle as a regex that matches it literally."""
    return re.sub(r"([.$?+*()\[\]{}|\\^])", r"\\\1", needle)


def any_of(haystack: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of the haystack (a plain column)."""
    return reduce(lambda a, b: a | b, [haystack.contains(n) for n in needles])


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rx(r"^\s+|\s+$"), F.lit(""))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~F.regexp_like(text, rx(r"\S"))


def prefix_pattern(prefixes: list[str]) -> Column:
    """Any of the prefixes at the start of the text; earlier ones win."""
    return rx("^(?:" + "|".join(literal(p) for p in prefixes) + ")", ignore_case=True)


def drop_first_prefix(text: Column, prefixes: list[str]) -> Column:
    return F.regexp_replace(text, prefix_pattern(prefixes), F.lit(""))


# -- money --------------------------------------------------------------------

def extract_amount(text: Column) -> Column:
    hit = F.regexp_extract(text, f"(?idU){V.AMOUNT_PATTERN}", 0)
    # "50$" is turned round to "$50"; "30 bucks" stays as written
    return F.nullif(F.regexp_replace(hit, rx(r"^(\d+)\s*\$$"), F.lit(r"\$$1")), F.lit(""))


def trigger_type(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return (
        F.when(any_of(low, V.PAYMENT_APP_WORDS), "payment_app")
        .when(any_of(low, V.BILL_SPLIT_WORDS), "bill_splitting")
        .when(any_of(low, V.DEBT_WORDS), "owing_debt")
        .when(any_of(low, V.DIRECT_AMOUNT_WORDS), "direct_amount")
        .otherwise("general_money")
    )


def direction(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return (
        F.when(any_of(low, V.OFFER_PHRASES), "offer")
        .when(any_of(low, V.SPLIT_PHRASES), "split")
        .otherwise("request")
    )


# -- contact ------------------------------------------------------------------

def phone_window(text: Column) -> Column:
    """Lowercased text from 30 characters before the first digit to 30 past it."""
    low = F.lower(text)
    pos = F.regexp_instr(low, rx(r"\d"))
    start = F.greatest(F.lit(1), pos - 30)
    return F.when(pos > 0, F.substr(low, start, pos + 30 - start))


def extract_phone(text: Column) -> Column:
    near_stop_word = F.regexp_like(phone_window(text), F.lit("|".join(V.PHONE_STOP_WORDS)))

    def written(pattern: str, shape: str, out: str) -> Column:
        raw = F.regexp_extract(text, f"(?dU){pattern}", 0)  # '' when there is none
        digits = F.regexp_replace(raw, rx(r"\D"), F.lit(""))
        return F.regexp_replace(digits, rx(shape), F.lit(out))

    indian = written(V.PHONE_IN_PATTERN, r"^(?:91)?(\d{5})(\d{5})$", "+91 $1 $2")
    american = written(V.PHONE_US_PATTERN, r"^1?(\d{3})(\d{3})(\d{4})$", "+1 $1 $2 $3")
    # the Indian form wins when both are there
    first = F.regexp_extract(F.concat(indian, F.lit("|"), american), r"^\|?([^|]*)", 1)
    return F.nullif(F.when(near_stop_word, F.lit("")).otherwise(first), F.lit(""))


# -- alarm / calendar -----------------------------------------------------------

def duration_seconds(text: Column) -> Column:
    pattern = f"(?idU){V.DURATION_PATTERN}"
    n = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return F.try_multiply(n, F.when(F.startswith(unit, F.lit("h")), 3600).otherwise(60).cast("bigint"))


def valid_time_phrase(phrase: Column) -> Column:
    words = "|".join(w.replace(".", r"\.") for w in V.TIME_WORDS)
    ok = F.regexp_like(phrase, rx(r"\d")) | F.regexp_like(F.lower(phrase), rx(rf"\b(?:{words})\b"))
    return F.coalesce((F.length(phrase) >= 3) & ok, F.lit(False))


def strip_phrase(text: Column, phrase: Column) -> Column:
    cut = F.regexp_replace(F.replace(text, phrase, F.lit(" ")), rx(r"\s+"), F.lit(" "))
    return F.when(
        phrase.isNull() | (phrase == ""), text
    ).otherwise(F.btrim(cut, F.lit(ALARM_STRIP)))


def alarm_label(text: Column, phrase: Column) -> Column:
    out = strip_phrase(drop_first_prefix(text, V.ALARM_VERBS), phrase)
    for tail in (V.LABEL_TAIL_AT, V.LABEL_TAIL_DURATION):
        out = F.btrim(F.regexp_replace(out, rx(tail), F.lit("")), F.lit(ALARM_STRIP))
    return F.nullif(out, F.lit(""))


def calendar_title(text: Column, phrase: Column) -> Column:
    out = strip_phrase(drop_first_prefix(text, V.CALENDAR_PREFIXES), phrase)
    out = F.btrim(F.regexp_replace(out, rx(V.TITLE_TAIL), F.lit("")), F.lit(ALARM_STRIP))
    out = strip_space(F.regexp_replace(out, rx(V.TITLE_LEAD, True), F.lit("")))
    return F.nullif(out, F.lit(""))


def event_minutes(text: Column) -> Column:
    return F.when(F.regexp_like(text, rx(V.SHORT_EVENT_PATTERN, True)), 30).otherwise(60)


# -- maps -----------------------------------------------------------------------

def extract_place(text: Column) -> Column:
    return place_of(strip_space(text))


def place_of(t: Column) -> Column:
    """The place in a text that has no space around it."""

    def tidy(c: Column) -> Column:
        return F.btrim(c, F.lit(PLACE_STRIP))

    verbs = prefix_pattern(sorted(V.PLACE_VERBS, key=len, reverse=True))
    # a miss and an empty capture both give '', hence the explicit match tests
    return (
        F.when(F.regexp_like(t, verbs), tidy(F.regexp_replace(t, verbs, F.lit(""))))
        .when(
            F.regexp_like(t, rx(V.PLACE_FALLBACK_PATTERN, True)),
            tidy(F.regexp_extract(t, f"(?idU){V.PLACE_FALLBACK_PATTERN}", 1)),
        )
        .otherwise(F.nullif(tidy(t), F.lit("")))
    )
