"""Cooldown policy as a Structured Streaming query.

The same decision function as the batch replay, with one tracker per
(chat, intent) in the state store. Rows of a key are put in (ts, seq) order
within a micro-batch. Every row comes out: one older than what the key has already
applied, or older than the watermark where the key has no state (any more), is
reported as late and changes nothing. Event-time timers drop trackers that
have been idle for longer than the eviction window, so state stays bounded by
the chats that are alive.

Messages and controls may be two streams with a watermark each, of which the older
one counts. With ``hold``, rows wait in the state until the watermark has passed them and
are then applied in order of time: whichever stream is behind, decisions equal the batch
replay, and only rows behind the watermark are late.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from numbers import Number
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatsift.config import MESSAGE, OBSERVE, PolicyParams
from chatsift.operators.decision import Tracker, advance, alive
from chatsift.operators.enrich import fired_intents
from chatsift.operators.metrics import windowed_metrics
from chatsift.operators.policy import policy_events
from chatsift.operators.respond import frame_response, replies
from chatsift.operators.state import cleared_intents, control_results, described
from chatsift.plans.end_to_end import CARRIED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STATE = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("last_popup", T.LongType()),
    T.StructField("last_event", T.LongType()),
    T.StructField("key1", T.StringType()),
    T.StructField("key2", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("popup_count", T.LongType()),
    T.StructField("suppression_count", T.LongType()),
    T.StructField("reason", T.StringType()),
    # newest event applied, and when to look at the key again (ms, 0 = no timer)
    T.StructField("applied_us", T.LongType()),
    T.StructField("applied_seq", T.LongType()),
    T.StructField("timer_ms", T.LongType()),
])

DECISION_FIELDS = [
    T.StructField("should_popup", T.BooleanType()),
    T.StructField("suppressed_reason", T.StringType()),
    T.StructField("cooldown_remaining_seconds", T.IntegerType()),
    T.StructField("chat_state", T.StringType()),
    T.StructField("previous_state", T.StringType()),
    T.StructField("existed", T.BooleanType()),
    T.StructField("popup_count", T.LongType()),
    T.StructField("suppression_count", T.LongType()),
    T.StructField("last_popup_us", T.LongType()),
    T.StructField("last_event_us", T.LongType()),
    T.StructField("state_reason", T.StringType()),
    T.StructField("last_payload", T.StringType()),
    T.StructField("late", T.BooleanType()),
]
_DECIDED = [f.name for f in DECISION_FIELDS]


#: What the stateful step is given and hands on: the rest of a row travels as one text.
_SENT = T.StructType([
    T.StructField("chat_id", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("us", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key1", T.StringType()),
    T.StructField("key2", T.StringType()),
    T.StructField("payload_json", T.StringType()),
    T.StructField("rest", T.StringType()),
    T.StructField("no_seq", T.BooleanType()),
])
_PLAIN = [f.name for f in _SENT.fields if f.name not in ("us", "rest", "no_seq")] + ["ts"]
_OUT = T.StructType(_SENT.fields + DECISION_FIELDS)
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Time of a row without one: older than all, so it is late.
_NEVER = -(2**62)

# Held rows, a few thousand to a page, by the hour they belong to: no state value grows with a chat.
_HOUR = T.StructType([T.StructField("hour", T.LongType())])
_PAGES = T.StructType([T.StructField("pages", T.LongType()), T.StructField("first_us", T.LongType())])
_PAGE = T.StructType([T.StructField("hour", T.LongType()), T.StructField("page", T.LongType())])
_HELD = T.StructType([T.StructField("rows", T.BinaryType())])
HOUR_US = 3_600_000_000
PAGE_ROWS = 2_000
#: Characters of rows that are sorted or held back in memory; beyond them sorted runs go to a file of the task.
SORT_CHARS = 32_000_000
#: Rows of a key that are handed on at a time.
OUT_ROWS = 5_000

_TIME = itemgetter(2, 3)  # (us, seq) of a row


def _chars(row: tuple) -> int:
    return 400 + sum(len(c) for c in row[6:9] if c)


def in_order(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows by (us, seq) in bounded memory: sorted runs in a temporary file, merged."""
    with tempfile.TemporaryFile() as file:
        run, chars, runs = [], 0, []
        for row in rows:
            run.append(row)
            chars += _chars(row)
            if chars >= SORT_CHARS:
                run.sort(key=_TIME)
                starts = [file.tell()]
                for i in range(0, len(run), 500):
                    pickle.dump(run[i:i + 500], file, pickle.HIGHEST_PROTOCOL)
                    starts.append(file.tell())
                runs.append(starts)
                run, chars = [], 0
        run.sort(key=_TIME)

        def read(starts: list[int]) -> Iterator[tuple]:
            for start in starts[:-1]:
                file.seek(start)
                yield from pickle.load(file)

        yield from heapq.merge(*map(read, runs), run, key=_TIME)


class CooldownProcessor(StatefulProcessor):
    """Applies the decision function to each key's events, in bounded memory whatever a key has."""

    def __init__(self, params: PolicyParams, hold: bool = False):
        self.params, self.hold = params, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("tracker", _STATE)
        if self.hold:
            self.hours = handle.getMapState("hours", _HOUR, _PAGES)
            self.held = handle.getMapState("held", _PAGE, _HELD)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = {c: None if pd.isna(v) else v for c, v in initialState.iloc[0].items()}
        tracker = Tracker(*[int(r[f]) if isinstance(r[f], Number) else r[f] for f in Tracker._fields])
        timer = self._expiry_ms(tracker.last_event)
        self.handle.registerTimer(timer)
        applied = int(r["applied_us"]), _NEVER if r["applied_seq"] is None else int(r["applied_seq"])
        self._save(tracker, applied, timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        given = (row for frame in rows for row in frame.itertuples(index=False, name=None))
        return _frames(self._keep(given, watermark) if self.hold else self._apply(given, watermark))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.hold:
            yield from _frames(self._let_go(watermark))
        saved = self.value.get()
        if saved is not None:
            # every event still to be applied is newer than the watermark
            tracker = alive(Tracker(*saved[:9]) if saved[0] is not None else None, watermark * 1000, self.params.eviction)
            if tracker is None:
                self.value.clear()
            elif saved[11] <= watermark:
                timer = self._expiry_ms(tracker.last_event)
                self.handle.registerTimer(timer)
                self._save(tracker, (saved[9], saved[10]), timer)

    def close(self) -> None:
        pass

    def _keep(self, rows: Iterable[tuple], watermark: int) -> Iterator[tuple]:
        """Hold rows until the watermark has passed them; yields those that it has passed already."""
        by_hour, chars, first = defaultdict(list), 0, None
        for row in rows:
            us = row[2]
            if us // 1000 < watermark:
                yield self._late(row)
                continue
            by_hour[us // HOUR_US].append(row)
            chars += _chars(row)
            first = us if first is None else min(first, us)
            if chars >= SORT_CHARS:
                self._hold(by_hour)
                by_hour, chars = defaultdict(list), 0
        self._hold(by_hour)
        if first is not None:
            self._wake(first)

    def _hold(self, by_hour: dict[int, list[tuple]]) -> None:
        for hour, rows in by_hour.items():
            pages, first = self.hours.getValue((hour,)) or (0, rows[0][2])
            for i in range(0, len(rows), PAGE_ROWS):
                body = zlib.compress(pickle.dumps(rows[i:i + PAGE_ROWS], pickle.HIGHEST_PROTOCOL), 1)
                self.held.updateValue((hour, pages), (body,))
                pages += 1
            self.hours.updateValue((hour,), (pages, min(first, min(r[2] for r in rows))))

    def _let_go(self, watermark: int) -> Iterator[tuple]:
        """Apply what the watermark has passed, hour by hour."""
        hours = sorted((h[0], *n) for h, n in self.hours.iterator())
        due = [(hour, pages) for hour, pages, first in hours if first // 1000 < watermark]
        rest: list[tuple] = []

        def passed() -> Iterator[tuple]:
            for hour, pages in due:
                whole = (hour + 1) * HOUR_US <= watermark * 1000
                yield from in_order(self._taken(hour, pages, None if whole else watermark, rest))

        if due:
            yield from self._apply(passed(), 0, sort=False)
        left = [first for _, _, first in hours[len(due):]] + rest
        if left:
            self._wake(min(left))

    def _taken(self, hour: int, pages: int, watermark: int | None, rest: list[int]) -> Iterator[tuple]:
        """Rows of an hour, taken out of the state; those the watermark hasn't passed go back, their first time to ``rest``."""
        kept, first = 0, None
        for page in range(pages):
            rows = pickle.loads(zlib.decompress(bytes(self.held.getValue((hour, page))[0])))
            self.held.removeKey((hour, page))
            later = [] if watermark is None else [r for r in rows if r[2] // 1000 >= watermark]
            if later:
                self.held.updateValue((hour, kept), (zlib.compress(pickle.dumps(later, pickle.HIGHEST_PROTOCOL), 1),))
                kept, first = kept + 1, min(r[2] for r in later) if first is None else min(first, min(r[2] for r in later))
                rows = [r for r in rows if r[2] // 1000 < watermark]
            yield from rows
        if kept:
            self.hours.updateValue((hour,), (kept, first))
            rest.append(first)
        else:
            self.hours.removeKey((hour,))

    def _late(self, row: tuple) -> tuple:
        return (*row, *[None] * 12, True)

    def _apply(self, rows: Iterable[tuple], watermark: int, sort: bool = True) -> Iterator[tuple]:
        saved = self.value.get()
        # without state, the watermark is the oldest time that can still be judged
        tracker, applied, timer = None, (watermark * 1000, -(2**62)), 0
        fresh = saved is None
        if saved is not None:
            tracker = Tracker(*saved[:9]) if saved[0] is not None else None
            applied, timer = (saved[9], saved[10]), saved[11]
        for row in in_order(rows) if sort else rows:
            _, _, us, seq, kind, key1, key2, body, *_ = row
            if (us, seq) < applied:
                yield self._late(row)
                continue
            applied, fresh = (us, seq), False
            tracker, o = advance(tracker, kind, us, key1, key2, body, self.params)
            t = tracker or Tracker("idle", None, None, None, None, None, 0, 0, None)
            yield (
                *row, o.should_popup, o.suppressed_reason, o.remaining, t.state, o.previous_state,
                o.existed, t.popup_count, t.suppression_count, t.last_popup, t.last_event, t.reason,
                t.payload, False,
            )
        if not fresh:  # else late rows only
            if not timer:
                timer = self._expiry_ms(applied[0])
                self.handle.registerTimer(timer)
            self._save(tracker, applied, timer)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def _expiry_ms(self, us: int) -> int:
        return us // 1000 + self.params.eviction * 1000 + 1

    def _save(self, tracker, applied, timer) -> None:
        body = tuple(tracker) if tracker is not None else (None,) * 9
        self.value.update((*body, *applied, timer))


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded size; as objects, so that whole numbers beside nulls stay whole."""
    chars, some = 0, []
    for row in rows:
        some.append(row)
        chars += _chars(row)
        if len(some) == OUT_ROWS or chars >= SORT_CHARS:
            yield pd.DataFrame(some, columns=_OUT.names, dtype=object)
            chars, some = 0, []
    if some:
        yield pd.DataFrame(some, columns=_OUT.names, dtype=object)


def decide_stream(
    events: DataFrame, params: PolicyParams = PolicyParams(), watermark: str | None = "10 minutes", hold: bool = False,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Streaming form of the batch replay; same columns plus ``late``.

    ``watermark`` None: the events have one already. ``hold``: wait for the watermark
    before rows are applied. ``initial``: trackers to begin with (``state.trackers``), read in the
    first micro-batch. Rows without a chat skip the state store. The watermark drives timers only: the
    stateful step gets the time as a number, so rows below the watermark
    reach it and come out as late instead of being dropped. Columns that the policy doesn't read pass
    it as one JSON text, made and read by Spark.
    """
    kind_of = events.schema["ts"].dataType
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", watermark) if watermark else events
    rows = marked.withColumn("_us", us).withColumn("ts", F.timestamp_micros("_us").cast(kind_of))
    has_chat = F.coalesce("chat_id", F.lit("")) != ""
    names = events.columns
    others = T.StructType([f for f in events.schema.fields if f.name not in _PLAIN])
    rest = F.to_json(F.struct(*others.names), _TIMES) if others.names else F.lit(None).cast("string")
    never = F.lit(_NEVER).cast("long")
    sent = rows.where(has_chat).select(
        "chat_id", "intent", F.coalesce("_us", never).alias("us"), F.coalesce(F.col("seq").cast("long"), never).alias("seq"),
        "kind", "key1", "key2", "payload_json", rest.alias("rest"), F.col("seq").isNull().alias("no_seq"),
    )
    decided = sent.groupBy("chat_id", "intent").transformWithStateInPandas(
        statefulProcessor=CooldownProcessor(params, hold), outputStructType=_OUT,
        outputMode="Append", timeMode="EventTime", initialState=initial and initial.groupBy("chat_id", "intent"),
    )
    read = F.from_json("rest", others, _TIMES | {"maxStringLen": str(2**31 - 1)}) if others.names else F.lit(None)
    back = {n: F.col(f"_read.{n}") for n in others.names} | {
        "ts": F.timestamp_micros(F.nullif("us", never)).cast(kind_of),
        "seq": F.when(~F.col("no_seq"), F.col("seq")).cast(events.schema["seq"].dataType),
    }
    tracked = decided.withColumn("_read", read).select(*[back.get(n, F.col(n)).alias(n) for n in names], *_DECIDED)
    pops = F.when(F.col("kind") == MESSAGE, F.lit(True))
    bare = {f.name: F.lit(None).cast(f.dataType) for f in DECISION_FIELDS}
    bare.update(
        should_popup=pops, cooldown_remaining_seconds=F.when(pops, 0).cast("int"),
        chat_state=F.lit("untracked"), late=F.lit(False),
    )
    untracked = rows.where(~has_chat & F.col("kind").isin(MESSAGE, OBSERVE)).drop("_us").withColumns(bare)
    return tracked.unionByName(untracked)


def enrich_stream(
    messages: DataFrame,
    controls: DataFrame | None = None,
    params: PolicyParams = PolicyParams(),
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    keep: list[str] | None = None,
    watermark: str = "10 minutes",
    keys: dict[str, list[str]] | None = None,
    control_watermark: str | None = None,
    hold: bool = False,
    initial: DataFrame | None = None,
) -> DataFrame:
    """End to end on streams: the batch enrichment up to the stateful step.

    ``controls`` may be a stream of its own, with ``control_watermark`` (None: the messages').
    """
    messages = messages.withWatermark("ts", watermark)
    if controls is not None:
        controls = controls.withWatermark("ts", control_watermark or watermark)
    fired = fired_intents(messages, params, scorer, keep="money")
    return decide_stream(policy_events(fired, controls, CARRIED if keep is None else keep, keys), params, None, hold, initial)


def settled(decisions: DataFrame) -> DataFrame:
    """Decisions with something definite for late messages: no popup, reason and state ``late``."""
    late = F.col("late")
    return decisions.withColumns({
        "should_popup": F.when(late & (F.col("kind") == MESSAGE), False).otherwise(F.col("should_popup")),
        "suppressed_reason": F.when(late, "late").otherwise(F.col("suppressed_reason")),
        "cooldown_remaining_seconds": F.when(late, 0).otherwise(F.col("cooldown_remaining_seconds")),
        "chat_state": F.when(late, "late").otherwise(F.col("chat_state")),
    })


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_decisions(
    decisions: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append decision rows to a Parquet table."""
    use_rocksdb(decisions.sparkSession)
    writer = (
        decisions.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_responses(
    decisions: DataFrame, path: str, checkpoint: str, keep: list[str] = ("message_id", "sender"),
    raw: str | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Append one reply per message, as nested rows or, with ``raw`` naming the
    column of the input frames, as response text.

    All decisions of a message come from one input row and so share a
    micro-batch: replies are put together per micro-batch, without more state.
    """
    use_rocksdb(decisions.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        out = replies(settled(batch), [*keep, raw] if raw else list(keep))
        if raw:
            out = out.select("seq", frame_response(F.col(raw), F.col("intents")).alias("response"))
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


SERVED = ["decisions", "replies", "control_answers", "reset_answers"]


def start_service(
    decisions: DataFrame, root: str, checkpoint: str, params: PolicyParams = PolicyParams(), available_now: bool = False,
) -> StreamingQuery:
    """One stateful query with four tables below ``root``: decisions, replies, and the answers to controls and to resets.

    All rows of a message or of a control share a micro-batch. Each micro-batch writes its own folder in
    every table, so one that is run again after a failure replaces itself.
    """
    use_rocksdb(decisions.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        known = batch.where(~F.col("late"))
        tables = {
            "decisions": batch, "replies": replies(settled(batch)),
            "control_answers": control_results(known, params), "reset_answers": cleared_intents(known),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")
        batch.unpersist()

    writer = decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_counters(decisions: DataFrame, path: str, checkpoint: str, every: str = "1 minute", available_now: bool = False) -> StreamingQuery:
    """Counters per event-time window and intent that lose no row, however late.

    Each micro-batch writes what it adds, one row per window and intent, late rows in a
    column of their own; :func:`counters` sums the parts. There is no watermark and no
    state, and a micro-batch that is run again replaces its part.
    """
    use_rocksdb(decisions.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        windowed_metrics(settled(batch), every, late=True).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals per window and intent of all parts written so far."""
    parts = spark.read.parquet(path)
    names = ("detected", "popups_fired", "popups_suppressed", "late")
    return parts.groupBy("window_start", "intent").agg(*[F.sum(c).alias(c) for c in names])


def live_snapshot(spark: SparkSession, checkpoint: str, as_of: Column, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Live trackers of a running or stopped query, read from its state store; columns as of the batch snapshot.

    It tells the state after the last finished micro-batch; ``as_of`` is the clock that
    says what is left of cooldowns and which trackers have expired.
    """
    store = spark.read.format("statestore").option("stateVarName", "tracker").load(checkpoint)
    names = {"state": "chat_state", "last_popup": "last_popup_us", "last_event": "last_event_us", "payload": "last_payload",
             "popup_count": "popup_count", "suppression_count": "suppression_count", "reason": "state_reason"}
    return described(store.select("key.*", *[F.col(f"value.{a}").alias(b) for a, b in names.items()]), as_of, params)


def start_frame_split(parsed: DataFrame, good: str, bad: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Split parsed frames: good ones to a table, rejected ones to a dead-letter table."""

    def write(batch: DataFrame, epoch: int) -> None:
        # the epoch in the path makes a replayed micro-batch overwrite itself; parsed once for both
        batch = batch.persist()
        batch.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        batch.where(F.col("error").isNotNull()).select(
            "value", F.to_json(F.struct("error")).alias("response")
        ).write.mode("overwrite").parquet(f"{bad}/epoch={epoch}")
        batch.unpersist()

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
