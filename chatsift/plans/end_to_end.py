"""End to end: messages and controls to decisions and replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from chatsift.config import PolicyParams
from chatsift.operators.enrich import fired_intents
from chatsift.operators.policy import PIECE_SECONDS, decide, policy_events

CARRIED = ["message_id", "sender", "ordinal", "confidence", "payload", "targeting"]


def enrich_and_decide(
    messages: DataFrame,
    controls: DataFrame | None = None,
    params: PolicyParams = PolicyParams(),
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    keep: list[str | Column] | None = None,
    observe: bool = True,
    piece_seconds: int = PIECE_SECONDS,
    keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Score, extract and decide. One row per fired intent and control.

    ``observe`` adds a row for each message without money, carrying the money
    state of its chat at that moment; replies and counters need them. ``keep``
    names the message columns (or expressions) to carry through the shuffle, ``keys`` the payload
    fields that tell a new action from a repeated one.
    """
    fired = fired_intents(messages, params, scorer, keep="money" if observe else "fired")
    events = policy_events(fired, controls, CARRIED if keep is None else keep, keys)
    return decide(events, params, piece_seconds)
