"""Tracker state as of a moment, per (chat, intent) and per chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.config import PolicyParams
from chatsift.functions.links import iso_utc
from chatsift.functions.payload import override_key_of_json


_TOLD = ["chat_state", "last_popup_us", "last_event_us", "last_payload", "popup_count", "suppression_count", "state_reason"]


def _last(decisions: DataFrame, as_of: Column | None) -> DataFrame:
    """The newest decision per (chat, intent); ``max_by`` aggregates map-side, so a hot chat ships one row per task."""
    rows = decisions.where(F.col("chat_state") != "untracked")
    rows = rows if as_of is None else rows.where(F.col("ts") <= as_of)
    return rows.groupBy("chat_id", "intent").agg(F.max_by(F.struct(*_TOLD, "ts", "seq"), F.struct("ts", "seq")).alias("s")).select(
        "chat_id", "intent", "s.*")


def snapshot(decisions: DataFrame, as_of: Column, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Live trackers at ``as_of``, one row per (chat, intent)."""
    return described(_last(decisions, as_of), as_of, params)


def trackers(decisions: DataFrame, as_of: Column | None = None, keys: dict | None = None) -> DataFrame:
    """Trackers with all that a stream needs to go on from them: their override values and the newest event applied.

    ``keys``: the payload fields that tell a new action from a repeated one, as for the decisions.
    """
    intent, body = F.col("intent"), F.col("last_payload")
    return _last(decisions, as_of).where(F.col("last_event_us").isNotNull()).select(
        "chat_id", "intent", F.col("chat_state").alias("state"), F.col("last_popup_us").alias("last_popup"),
        F.col("last_event_us").alias("last_event"), override_key_of_json(intent, body, 0, keys).alias("key1"),
        override_key_of_json(intent, body, 1, keys).alias("key2"), body.alias("payload"), "popup_count", "suppression_count",
        F.col("state_reason").alias("reason"), F.unix_micros(F.col("ts").cast("timestamp")).alias("applied_us"),
        F.col("seq").alias("applied_seq"),
    )


def described(last: DataFrame, as_of: Column, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Trackers that are alive at ``as_of``, with what is left of their cooldown."""
    now = F.unix_micros(as_of.cast("timestamp"))
    live = last.where(
        F.col("last_event_us").isNotNull()
        & (now - F.col("last_event_us") <= params.eviction * 1_000_000)
    )
    state = F.col("chat_state")
    window = (
        F.when(state == "post_payment", params.grace)
        .when(state == "dismissed", params.dismissed)
        .otherwise(params.cooldown)
    )
    since = F.when(state == "post_payment", F.col("last_event_us")).otherwise(F.col("last_popup_us"))
    left = F.greatest(F.lit(0).cast("bigint"), window.cast("bigint") * 1_000_000 - (now - since))
    return live.select(
        "chat_id", "intent", state.alias("state"),
        iso_utc(F.col("last_popup_us")).alias("last_popup_at"),
        iso_utc(F.col("last_event_us")).alias("last_event_at"),
        "last_payload", "popup_count", "suppression_count",
        F.floor(left / 1_000_000).cast("int").alias("cooldown_remaining_seconds"),
        F.col("state_reason").alias("reason_for_current_state"),
    )


def chat_states(chats: DataFrame, snap: DataFrame) -> DataFrame:
    """One row per asked chat: its intents' trackers, or idle with a message."""
    body = [c for c in snap.columns if c not in ("chat_id", "intent")]
    per_chat = snap.groupBy("chat_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("intent", F.struct(*body).alias("tracker"))))
        ).alias("intents")
    )
    empty = F.col("intents").isNull()
    return chats.select("chat_id").join(per_chat, "chat_id", "left").select(
        "chat_id",
        F.when(empty, "idle").alias("state"),
        "intents",
        F.when(
            empty, "no tracker entries — next message will popup for any detected intent"
        ).alias("message"),
    )


def control_results(decisions: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Answers to payments, dismissals and scoped resets."""
    kind = F.col("kind")
    return decisions.where(
        kind.isin("payment_complete", "popup_dismissed") | ((kind == "reset_cooldown") & F.col("scoped"))
    ).select(
        "seq", "chat_id", "intent", "kind", "chat_state",
        F.when(kind != "reset_cooldown", F.col("previous_state")).alias("previous_state"),
        F.when(kind == "payment_complete", F.col("popup_count")).alias("popup_count_total"),
        F.when(kind == "payment_complete", params.grace).alias("grace_window_seconds"),
        F.when(kind == "popup_dismissed", params.dismissed).alias("cooldown_seconds"),
        F.when(kind == "reset_cooldown", F.col("existed")).alias("existed"),
    )


def cleared_intents(decisions: DataFrame) -> DataFrame:
    """Answers to unscoped resets: which intents had a tracker."""
    return (
        decisions.where((F.col("kind") == "reset_cooldown") & ~F.col("scoped"))
        .groupBy("seq", "chat_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("existed"), F.col("intent")))).alias("cleared_intents"))
        .withColumn("chat_state", F.lit("idle"))
    )
