"""Service counters over decision rows (which include observe rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.config import INTENTS, MESSAGE, OBSERVE


def _counters() -> dict[str, Column]:
    fired = F.col("kind") == MESSAGE
    tracked = F.col("chat_state") != "untracked"
    money = F.col("intent") == "money"
    return {
        # every message has exactly one money row, fired or observed
        "requests": F.count_if(money & F.col("kind").isin(MESSAGE, OBSERVE)),
        "money_detected": F.count_if(money & fired),
        "popups_fired": F.count_if(fired & tracked & F.col("should_popup")),
        "popups_suppressed": F.count_if(fired & tracked & ~F.col("should_popup")),
    }


def _rates() -> dict[str, Column]:
    fired, suppressed = F.col("popups_fired"), F.col("popups_suppressed")
    return {
        "detection_rate": F.round(F.col("money_detected") / F.greatest("requests", F.lit(1)), 4),
        "suppression_rate": F.round(suppressed / F.greatest(fired + suppressed, F.lit(1)), 4),
    }


def service_metrics(decisions: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Requests, detections, popups and their rates, as one row.

    Without observe rows in ``decisions``, pass the accepted messages: counting
    them apart is cheaper than sending every quiet message through the fold.
    """
    counters = _counters()
    if messages is None:
        return decisions.agg(*[c.alias(n) for n, c in counters.items()]).withColumns(_rates())
    counters.pop("requests")
    one = F.lit(1).alias("_one")  # both sides are one row
    asked = messages.agg(F.count("*").alias("requests")).select(one, "requests")
    done = decisions.agg(*[c.alias(n) for n, c in counters.items()]).select(one, *counters)
    return asked.join(done, "_one").drop("_one").withColumns(_rates())


def intent_counts(decisions: DataFrame) -> DataFrame:
    """Detections per intent; all five are listed, zeros included."""
    fired = F.col("kind") == MESSAGE
    wide = decisions.agg(*[F.count_if(fired & (F.col("intent") == i)).alias(i) for i in INTENTS])
    pairs = F.array(*[F.struct(F.lit(i).alias("intent"), F.col(i).alias("detected")) for i in INTENTS])
    return wide.select(F.inline(pairs))


def mean_latency(messages: DataFrame) -> DataFrame:
    return messages.agg(F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"))


def active_trackers(snap: DataFrame) -> DataFrame:
    return snap.agg(F.count("*").alias("active_chat_trackers"))


def windowed_metrics(decisions: DataFrame, every: str = "1 minute", watermark: str | None = None, late: bool = False) -> DataFrame:
    """Counters per event-time window and intent; for tables and streams. ``late``: rows decided as late apart from the others."""
    rows = decisions.withWatermark("ts", watermark) if watermark else decisions
    keep = {k: v for k, v in _counters().items() if k in ("popups_fired", "popups_suppressed")}
    if late:
        keep = {k: F.count_if(~F.col("late") & (F.col("should_popup") if k == "popups_fired" else ~F.col("should_popup"))
                              & (F.col("chat_state") != "untracked")) for k in keep} | {"late": F.count_if("late")}
    return (
        rows.where(F.col("kind") == MESSAGE)
        .groupBy(F.window("ts", every).alias("w"), "intent")
        .agg(F.count("*").alias("detected"), *[c.alias(k) for k, c in keep.items()])
        .select(F.col("w.start").alias("window_start"), "intent", "detected", *keep)
    )
