"""The cooldown rules for one event of one (chat, intent), as a pure function.

Shared by the batch replay and the stream, so both decide alike. Times are
epoch microseconds; a tracker of ``None`` means the pair has no state.
"""

from __future__ import annotations

from typing import NamedTuple

SECOND = 1_000_000


class Tracker(NamedTuple):
    state: str
    last_popup: int
    last_event: int
    key1: str | None
    key2: str | None
    payload: str | None
    popup_count: int
    suppression_count: int
    reason: str


class Outcome(NamedTuple):
    should_popup: bool | None = None
    suppressed_reason: str | None = None
    remaining: int | None = None
    previous_state: str | None = None
    existed: bool = False


def alive(tracker: Tracker | None, now: int, eviction: int) -> Tracker | None:
    """The tracker, or None once it has been idle for longer than ``eviction``."""
    if tracker is not None and now - tracker.last_event > eviction * SECOND:
        return None
    return tracker


def _is_new_action(t: Tracker, key1: str | None, key2: str | None) -> bool:
    return bool(
        (t.key1 and key1 and t.key1 != key1) or (t.key2 and key2 and t.key2 != key2)
    )


def advance(tracker, kind, now, key1, key2, payload, params):
    """Apply one event; returns (tracker after, outcome)."""
    t = alive(tracker, now, params.eviction)
    existed = t is not None
    before = t.state if existed else "idle"
    if kind == "message":
        fire, reason, left = True, None, 0
        if existed:
            if before == "post_payment":
                window, since, reason = params.grace, t.last_event, "post_payment_grace"
            elif before == "dismissed":
                window, since, reason = params.dismissed, t.last_popup, "recently_dismissed"
            else:
                window, since, reason = params.cooldown, t.last_popup, "cooldown_active"
            rest = window * SECOND - (now - since)
            fire = rest <= 0 or (
                before != "post_payment" and _is_new_action(t, key1, key2)
            )
            left = rest // SECOND
        if fire:
            t = Tracker(
                "cooldown", now, now, key1, key2, payload,
                (t.popup_count if existed else 0) + 1,
                t.suppression_count if existed else 0,
                "popup_just_fired",
            )
            return t, Outcome(True, None, 0, before, existed)
        t = t._replace(suppression_count=t.suppression_count + 1)
        return t, Outcome(False, reason, left, before, existed)
    if kind == "observe":
        return t, Outcome(None, None, None, before, existed)
    if kind == "reset_cooldown":
        return None, Outcome(None, None, None, before, existed)
    base = t if existed else Tracker("idle", now, now, None, None, None, 0, 0, "")
    if kind == "payment_complete":
        t = base._replace(state="post_payment", last_event=now, reason="payment_completed")
        if key1:
            t = t._replace(key1=key1, key2=None, payload=payload)
    elif kind == "popup_dismissed":
        t = base._replace(
            state="dismissed", last_popup=now, last_event=now, reason="user_dismissed_popup"
        )
    else:
        raise ValueError(f"unknown event kind {kind!r}")
    return t, Outcome(None, None, None, before, existed)
