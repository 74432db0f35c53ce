"""Cooldown policy as a batch replay: ordered folds per (chat, intent).

Decisions depend on earlier decisions, so no window function can express them.
One plan for all sizes, in one job:

1. Events are shuffled once, by (chat, intent, piece of time), and sorted. So a hot
   chat is as many pieces as it has days.
2. Each piece says what it makes of any tracker it may be entered with. After an idle
   pause it starts afresh, whatever came before. Otherwise the entry matters only
   until every possible tracker has fired: a fire sets the tracker
   anew, so the table lists the events up to there, a window's worth, and for each of their
   messages the tracker at the end of the piece if it is the first to fire.
3. Per (chat, intent), one task goes through the tables of its pieces in order and finds the
   tracker that each piece is entered with. Counters are kept relative.
4. The sorted pieces are folded, side by side, each from its entry.

Nothing is collected, and no step repeats.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsift.config import DISMISSED, MESSAGE, OBSERVE, PAYMENT, RESET, PolicyParams
from chatsift.functions.payload import override_key, payload_json
from chatsift.operators.decision import SECOND, Tracker, advance, alive
from chatsift.operators.enrich import keyed_controls

KEY = ["chat_id", "intent"]
#: Seconds of one chat and intent that one step of a task holds.
PIECE_SECONDS = 86_400

_ADDED = [
    ("should_popup", T.BooleanType(), pa.bool_()),
    ("suppressed_reason", T.StringType(), pa.string()),
    ("cooldown_remaining_seconds", T.IntegerType(), pa.int32()),
    ("chat_state", T.StringType(), pa.string()),
    ("previous_state", T.StringType(), pa.string()),
    ("existed", T.BooleanType(), pa.bool_()),
    ("popup_count", T.LongType(), pa.int64()),
    ("suppression_count", T.LongType(), pa.int64()),
    ("last_popup_us", T.LongType(), pa.int64()),
    ("last_event_us", T.LongType(), pa.int64()),
    ("state_reason", T.StringType(), pa.string()),
    ("last_payload", T.StringType(), pa.string()),
]

_NOTHING = (None,) * len(_ADDED)
_UNTRACKED = {
    MESSAGE: (True, None, 0, "untracked") + (None,) * (len(_ADDED) - 4),
    OBSERVE: (None, None, None, "untracked") + (None,) * (len(_ADDED) - 4),
}


def policy_events(
    fired: DataFrame, controls: DataFrame | None = None, keep: list[str | Column] | None = None,
    keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Messages and controls in one ordered table, ready for :func:`decide`.

    ``keep`` lists further message columns to carry through, or expressions on them. ``keys`` names, per
    intent, up to two payload fields whose change makes a new action; None: the usual ones.
    """
    intent, payload = F.col("intent"), F.col("payload")
    kind = F.when(F.col("fired"), MESSAGE).otherwise(OBSERVE) if "fired" in fired.columns else F.lit(MESSAGE)
    rows = fired.select(
        *[c for c in ("seq", "ts", "chat_id", "intent") if c in fired.columns],
        kind.alias("kind"),
        override_key(intent, payload, 0, keys).alias("key1"),
        override_key(intent, payload, 1, keys).alias("key2"),
        F.when(kind == MESSAGE, payload_json(intent, payload)).alias("payload_json"),
        *[c if isinstance(c, Column) else F.col(c) for c in keep or []],
    )
    if controls is None:
        return rows
    ctl = keyed_controls(controls).select(
        "seq", "ts", "chat_id", "intent", "kind",
        F.col("amount").alias("key1"),
        F.lit(None).cast("string").alias("key2"),
        F.when(
            (F.col("kind") == PAYMENT) & F.col("amount").isNotNull(), F.to_json(F.struct("amount"))
        ).alias("payload_json"),
        "scoped",
    )
    return rows.unionByName(ctl, allowMissingColumns=True)


def _tracked():
    return F.coalesce("chat_id", F.lit("")) != ""


def decide(events: DataFrame, params: PolicyParams = PolicyParams(), piece_seconds: int = PIECE_SECONDS) -> DataFrame:
    """Fold ordered events into one decision row per event.

    Histories are cut every ``piece_seconds``; results don't depend on it. Rows
    without a chat are never tracked: they pop, and are spread by their number.
    """
    piece = [*KEY, "_piece"]
    order = [*piece, "ts", "seq"]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = F.when(_tracked(), F.floor(us / (piece_seconds * SECOND))).otherwise(F.col("seq"))
    rows = events.withColumns({"_us": us, "_piece": cut.cast("long")}).repartition(*piece)
    tables = _read_by_tables(rows, order).mapInArrow(lambda b: _tables(b, params), "c string, i string, p long, body string")
    entries = tables.repartition("c", "i").sortWithinPartitions("c", "i", "p").mapInArrow(
        lambda b: _entries(b, params), "c string, i string, p long, _entry string")
    # the shuffle of the rows is the same in both branches, so Spark runs it once
    entered = rows.join(entries, [rows[a] == entries[b] for a, b in zip(piece, "cip")], "left").drop("c", "i", "p")
    schema = T.StructType(rows.schema.fields + [T.StructField(name, kind) for name, kind, _ in _ADDED])
    folded = entered.sortWithinPartitions(*order).mapInArrow(lambda b: _fold(b, params), schema)
    return folded.drop("_us", "_piece")


def _read_by_tables(rows: DataFrame, order: list[str]) -> DataFrame:
    """The sorted columns that the tables are made of: others are neither sorted nor handed to Python.

    Their hash keeps them in the shuffle, or it would be another one than that of the fold
    and all work before it done twice. Columns that have no hash go along.
    """
    mine = [*order, "_us", "kind", "key1", "key2", "payload_json"]
    others = [f for f in rows.schema.fields if f.name not in mine]
    bare = [f.name for f in others if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    whole = [f.name for f in others if f.name not in bare]
    mark = [F.xxhash64(*[F.col(f"`{c}`") for c in bare]).alias("_others")] if bare else []
    return rows.select(*mine, *[F.col(f"`{c}`") for c in whole], *mark).sortWithinPartitions(*order)


def _fold(batches, params):
    """Fold sorted pieces, each from the tracker it is entered with."""
    piece, tracker = None, None
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in (
            "chat_id", "intent", "_piece", "_entry", "kind", "_us", "key1", "key2", "payload_json")]
        out = []
        for chat, intent, p, entry, kind, now, key1, key2, body in zip(*cols):
            if not chat:
                out.append(_UNTRACKED.get(kind, _NOTHING))
                continue
            if (chat, intent, p) != piece:
                piece, tracker = (chat, intent, p), Tracker(*json.loads(entry)) if entry else None
            tracker, o = advance(tracker, kind, now, key1, key2, body, params)
            if tracker is None:
                out.append((o.should_popup, o.suppressed_reason, o.remaining, "idle",
                            o.previous_state, o.existed, 0, 0, None, None, None, None))
            else:
                out.append((o.should_popup, o.suppressed_reason, o.remaining, tracker.state,
                            o.previous_state, o.existed, tracker.popup_count,
                            tracker.suppression_count, tracker.last_popup,
                            tracker.last_event, tracker.reason, tracker.payload))
        columns = list(zip(*out)) or [()] * len(_ADDED)
        added = [pa.array(v, t) for v, (_, _, t) in zip(columns, _ADDED)]
        names = [n for n in batch.schema.names if n != "_entry"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + added, names=names + [n for n, _, _ in _ADDED])


# -- what a piece makes of any entry ----------------------------------------------------

def _pieces(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """(chat, intent, piece) and its events (kind, us, key1, key2, payload), in order."""
    piece, events = None, []
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("chat_id", "intent", "_piece", "kind", "_us", "key1", "key2", "payload_json")]
        for chat, intent, p, *event in zip(*cols):
            if not chat:
                continue
            if (chat, intent, p) != piece:
                if events:
                    yield piece, events
                piece, events = (chat, intent, p), []
            events.append(tuple(event))
    if events:
        yield piece, events


def _tables(batches, params):
    rows = []
    for piece, events in _pieces(batches):
        rows.append((*piece, json.dumps(table(events, params))))
        if len(rows) == 1000:
            yield _batch(rows, "body")
            rows = []
    if rows:
        yield _batch(rows, "body")


def _batch(rows: list[tuple], last: str) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["c", "i", "p", last])


def table(events: list[tuple], params: PolicyParams) -> list:
    """[time of the first event, tracker at the end, events up to where every entry has fired, {message: (end, carried)}].

    With a pause inside, the end is known: the last session starts from nothing.
    Otherwise it follows from the entry, see :func:`leave`.
    """
    first, pause = events[0][1], params.eviction * SECOND
    for start in range(len(events) - 1, 0, -1):
        if events[start][1] - events[start - 1][1] > pause:
            tracker = None
            for kind, now, *rest in events[start:]:
                tracker, _ = advance(tracker, kind, now, *rest, params)
            return [first, tracker, None, None]
    # the longest that a tracker from before can keep quiet; None: it is gone
    quiet: int | None = first + max(params.cooldown, params.dismissed, params.grace) * SECOND
    n = 0
    for n, (kind, now, *_) in enumerate(events, 1):
        if kind == MESSAGE and (quiet is None or now >= quiet):
            break
        if kind in (RESET, PAYMENT, DISMISSED):
            quiet = None if kind == RESET else now + SECOND * (params.grace if kind == PAYMENT else params.dismissed)
    head = events[:n]
    return [first, None, head, ends(events, [i for i, e in enumerate(head) if e[0] == MESSAGE], params)]


def ends(events: list[tuple], starts: list[int], params: PolicyParams) -> dict[int, tuple[Tracker | None, bool]]:
    """Tracker at the end if the message at a start fires, counted from there, and whether its counters lived on.

    From fire to fire: the next one is the first message after the cooldown or with
    another action, found without a look at those between, unless a control comes before it.
    """
    n = len(events)
    control = [n] * (n + 1)  # the next control
    other = [n] * n  # the next message with another action
    near: list[tuple[str | None, int]] = [(None, n), (None, n)]
    beyond = [n, n]  # the next message whose key differs from the nearest one's
    for i in range(n - 1, -1, -1):
        kind, _, *keys = events[i][:4]
        control[i] = control[i + 1] if kind in (MESSAGE, OBSERVE) else i
        if kind != MESSAGE:
            continue
        for k in (0, 1):
            if keys[k]:
                if near[k][0] != keys[k]:
                    beyond[k] = near[k][1]
                near[k] = (keys[k], i)
                other[i] = min(other[i], beyond[k])
    messages = [i for i, e in enumerate(events) if e[0] == MESSAGE]
    times = [events[i][1] for i in messages]
    rank = {i: r for r, i in enumerate(messages)}

    def step(i: int) -> tuple[int, Tracker | None, int, int, bool]:
        """(next fire or n, tracker at the end, popups, quiet messages, carried) after a fire at i."""
        now, key1, key2, body = events[i][1:]
        t = Tracker("cooldown", now, now, key1, key2, body, 0, 0, "popup_just_fired")
        r = max(rank[i] + 1, bisect_left(times, now + min(params.cooldown * SECOND, params.eviction * SECOND + 1)))
        j = min(messages[r] if r < len(messages) else n, other[i])
        c = control[i + 1]
        if j < c:
            carried = events[j][1] - now <= params.eviction * SECOND
            return j, None, 1, rank[j] - rank[i] - 1 if carried else 0, carried
        t = t._replace(suppression_count=(bisect_left(messages, c) - rank[i] - 1))
        carried = True
        for j in range(c, n):
            kind, at, *rest = events[j]
            t, o = advance(t, kind, at, *rest, params)
            carried = carried and o.existed
            if o.should_popup:
                return j, None, t.popup_count, t.suppression_count, carried
            carried = carried and t is not None
        return n, t, 0, 0, carried

    known: dict[int, tuple[Tracker | None, bool]] = {}
    for start in starts:
        path, i = [], start
        while i not in known:
            j, t, popups, quiet, carried = step(i)
            if j == n:
                known[i] = (t, carried)
                break
            path.append((i, j, popups, quiet, carried))
            i = j
        for i, j, popups, quiet, carried in reversed(path):
            t, lived = known[j]
            if lived and t is not None:
                t = t._replace(popup_count=t.popup_count + popups, suppression_count=t.suppression_count + quiet)
            known[i] = (t, lived and carried)
    return {i: known[i] for i in starts}


def leave(entry: Tracker | None, head: list, at_end: dict, params: PolicyParams) -> Tracker | None:
    """The tracker at the end of a piece that is entered with ``entry``."""
    t = entry
    for i, (kind, now, *rest) in enumerate(head):
        t, o = advance(t, kind, now, *rest, params)
        if o.should_popup:
            end, carried = at_end[str(i)]
            if end is None:
                return None
            end = Tracker(*end)
            if carried:
                end = end._replace(
                    popup_count=end.popup_count + t.popup_count, suppression_count=end.suppression_count + t.suppression_count)
            return end
    return t


def _entries(batches, params):
    """The tracker that each piece is entered with, where there is one."""
    key, t = None, None
    for batch in batches:
        out = []
        for chat, intent, piece, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (chat, intent) != key:
                key, t = (chat, intent), None
            first, end, head, at_end = json.loads(body)
            t = alive(t, first, params.eviction)
            if t is not None:
                out.append((chat, intent, piece, json.dumps(t)))
            t = leave(t, head, at_end, params) if head else end and Tracker(*end)
        if out:
            yield _batch(out, "_entry")
