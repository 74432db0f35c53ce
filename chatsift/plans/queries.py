"""Registered queries: every operator over the shared tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.config import INTENTS, PolicyParams, scratch_path
from chatsift.functions import links as L
from chatsift.functions import payload as P
from chatsift.functions import scoring
from chatsift.functions import targeting as G
from chatsift.functions import text as X
from chatsift.functions import vocab as V
from chatsift.functions.timephrase import with_time_phrase
from chatsift.operators import dataset as DS
from chatsift.operators import enrich, evaluate, history, learn, metrics, respond, state
from chatsift.operators.policy import KEY, decide, policy_events
from chatsift.plans import derived as D
from chatsift.plans import end_to_end
from chatsift.plans.session import tune
from chatsift.sources import messages as S
from chatsift.streaming import decide as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF = "2024-01-20 00:00:00"
SEED = 42


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
    return fn


def _accepted(spark, sf):
    return enrich.accept_messages(D.messages(spark, sf))


def _fired(spark, sf):
    return enrich.fired_intents(D.messages(spark, sf), D.PARAMS)


def _decisions(spark, sf, observe=False, **kw):
    return end_to_end.enrich_and_decide(D.messages(spark, sf), D.controls(spark, sf), D.PARAMS, observe=observe, **kw)


# -- extractors -------------------------------------------------------------------------

@query
def trigger_totals(spark, sf):
    """Flagship: payment messages by trigger and direction, with their amounts."""
    p = F.col("payload")
    number = F.nullif(F.regexp_replace(p["amount"], r"[^0-9.]", ""), F.lit("")).cast("double")
    return (
        _fired(spark, sf).where("intent = 'money'")
        .groupBy(p["trigger_type"].alias("trigger_type"), p["direction"].alias("direction"))
        .agg(F.count("*").alias("n"), F.count(p["amount"]).alias("with_amount"),
             F.round(F.sum(number), 2).alias("total"))
    )


@query
def amounts(spark, sf):
    t = F.col("text")
    return _accepted(spark, sf).select(
        "seq", X.extract_amount(t).alias("amount"), X.trigger_type(t).alias("trigger_type"),
        X.direction(t).alias("direction"),
    )


@query
def phones_in_documents(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.extract_phone(F.col("text")).alias("phone"))


@query
def phones_in_pages(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", X.extract_phone(F.col("html")).alias("phone"))


@query
def phones_in_messages(spark, sf):
    return _accepted(spark, sf).select("seq", X.extract_phone(F.col("text")).alias("phone"))


@query
def durations(spark, sf):
    return _accepted(spark, sf).select("seq", X.duration_seconds(F.col("text")).alias("seconds"))


@query
def places(spark, sf):
    return _accepted(spark, sf).select("seq", X.extract_place(F.col("text")).alias("place"))


@query
def places_in_conversations(spark, sf):
    return D.conversations(spark, sf).select("seq", X.extract_place(F.col("text")).alias("place"))


@query
def targeting(spark, sf):
    t = G.with_targeting(_accepted(spark, sf), F.lit(True))
    return t.select("seq", "targeting.*")


@query
def time_phrases(spark, sf):
    timed = with_time_phrase(_accepted(spark, sf), "text", "ts")
    return timed.select(
        "seq", "time_iso", "time_phrase", X.valid_time_phrase(F.col("time_phrase")).alias("is_valid"),
        X.valid_time_phrase(F.col("text")).alias("names_a_time"),
    )


@query
def labels_and_titles(spark, sf):
    t, p = F.col("text"), F.col("time_phrase")
    timed = with_time_phrase(_accepted(spark, sf), "text", "ts")
    return timed.select(
        "seq", X.strip_phrase(t, p).alias("stripped"), X.alarm_label(t, p).alias("label"),
        X.calendar_title(t, p).alias("title"),
    )


@query
def iso_times(spark, sf):
    return D.events(spark, sf).select("event_id", L.iso_utc(F.unix_micros("ts")).alias("iso"))


# -- rejects, scores, fired intents -------------------------------------------------------

@query
def rejected_messages(spark, sf):
    return enrich.reject_messages(D.messages(spark, sf)).select("seq", "reason")


@query
def rejected_controls(spark, sf):
    return enrich.reject_controls(D.controls(spark, sf)).select("seq", "intent", "reason")


@query
def sigmoid_scores(spark, sf):
    logits = F.slice("embedding", 1, 5)
    probs = scoring.intent_probs(logits, scoring.label_order({str(i): n for i, n in enumerate(INTENTS)}, 5))
    return D.table(spark, sf, "embeddings").select("vec_id", probs.alias("p")).select(
        "vec_id", *[F.round(F.col("p")[i], 6).alias(i) for i in INTENTS]
    )


@query
def reordered_scores(spark, sf):
    """Outputs in another order, one of them unknown: it is ignored, its intent is 0."""
    order = scoring.label_order({0: "maps", 1: "money", 2: "spam", 3: "alarm", 4: "contact"}, 5)
    probs = scoring.intent_probs(F.slice("embedding", 1, 5), order)
    return D.table(spark, sf, "embeddings").select("vec_id", probs.alias("p")).select(
        "vec_id", *[F.round(F.col("p")[i], 6).alias(i) for i in INTENTS]
    )


@query
def softmax_scores(spark, sf):
    probs = scoring.intent_probs(F.slice("embedding", 1, 2), scoring.label_order(None, 2))
    return D.table(spark, sf, "embeddings").select(
        "vec_id", F.round(probs["money"], 6).alias("money"), probs["alarm"].alias("alarm")
    )


@query
def fired_intents(spark, sf):
    return _fired(spark, sf).select("seq", "chat_id", "intent", "confidence", "targeting.*")


@query
def payloads(spark, sf):
    i, p = F.col("intent"), F.col("payload")
    return _fired(spark, sf).select(
        "seq", "intent", P.payload_json(i, p).alias("payload"),
        P.override_key(i, p, 0).alias("key1"), P.override_key(i, p, 1).alias("key2"),
    )


@query
def conversation_intents(spark, sf):
    """Which messages of the conversations fire, intent by intent."""
    scored = enrich.with_scores(enrich.accept_messages(D.conversations(spark, sf)))
    return enrich.explode_scores(scored).where(F.col("confidence") >= 0.5).select("seq", "intent")


@query
def batch_scored(spark, sf):
    """The keyword rules as a batch-inference function run in Python workers."""
    keywords = [V.INTENT_KEYWORDS[i] for i in INTENTS]

    def make_predict():
        import numpy as np

        def predict(texts):
            lows = [str(t).lower() for t in texts]
            return np.array([[0.99 if any(k in t for k in ks) else 0.01 for ks in keywords] for t in lows])

        return predict

    scored = enrich.with_scores(_accepted(spark, sf), learn.batch_scorer(make_predict))
    return scored.select("seq", *[F.get("scores", F.lit(n)).alias(i) for n, i in enumerate(INTENTS)])


# -- decisions -----------------------------------------------------------------------------

DECISION = [
    "seq", "intent", "kind", "should_popup", "suppressed_reason", "cooldown_remaining_seconds",
    "chat_state", "previous_state", "existed", "popup_count", "suppression_count", "last_popup_us",
    "last_event_us", "state_reason", "last_payload",
]


@query
def decisions(spark, sf):
    return _decisions(spark, sf, keep=[]).select(DECISION)


@query
def hot_chat_decisions(spark, sf):
    """Histories cut into pieces of three hours, much shorter than the windows; quiet messages included."""
    return _decisions(spark, sf, observe=True, keep=[], piece_seconds=10_800).select(DECISION)


@query
def idle_sessions(spark, sf):
    """Trackers' lives apart: each event's number of the session it falls into, per chat and intent."""
    rows = policy_events(_fired(spark, sf), D.controls(spark, sf)).select("seq", "ts", "chat_id", "intent", "kind")
    out = history.sessions(rows, D.PARAMS.eviction, KEY, piece_seconds=36_000)
    return out.select("seq", "intent", "kind", "session")


@query
def session_totals(spark, sf):
    rows = policy_events(_fired(spark, sf), D.controls(spark, sf)).select("seq", "ts", "chat_id", "intent")
    out = history.session_totals(history.sessions(rows, D.PARAMS.eviction, KEY), KEY)
    return out.select("chat_id", "intent", "session", "events", "seconds")


@query
def states_as_of(spark, sf):
    """Every event of the log with the money tracker that its chat had right before it."""
    chat = "CASE WHEN user_id % 3 = 0 THEN 'chat_hot' WHEN user_id % 7 = 1 THEN NULL ELSE 'chat_' || cast(user_id % 11 as varchar(9)) END"
    log = D.events(spark, sf).select(F.col("event_id").alias("seq"), "ts", F.expr(chat).alias("chat_id"), F.lit("money").alias("intent"))
    told = ["chat_state", "popup_count", "suppression_count", "last_event_us"]
    known = history.as_of(log, _decisions(spark, sf, keep=[]).where("chat_state <> 'untracked'"), KEY, told)
    return known.select("seq", *[F.col("known")[c].alias(c) for c in told])


KEYS = {"money": ["direction"], "maps": ["place"]}


@query
def custom_key_decisions(spark, sf):
    """Another direction makes a new money action, another place a new trip; nothing else does."""
    d = end_to_end.enrich_and_decide(D.messages(spark, sf), None, D.PARAMS, keep=[], observe=False, keys=KEYS)
    return d.select("seq", "intent", "should_popup", "suppressed_reason", "cooldown_remaining_seconds", "popup_count")


@query
def stored_messages(spark, sf):
    """Messages written as JSON lines and read by the message source."""
    path = scratch_path(spark, "messages")
    D.messages(spark, sf).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return S.read_messages(spark, path, "json").select("seq", "ts", "message_id", "chat_id", "sender", "text")


@query
def stored_controls(spark, sf):
    path = scratch_path(spark, "controls")
    D.controls(spark, sf).write.parquet(path)
    return S.read_controls(spark, path).select("seq", "ts", "chat_id", "kind", "intent", "amount")


@query
def stored_replies(spark, sf):
    """Replies through the batch sink: nested rows as Parquet, read again."""
    path = scratch_path(spark, "replies")
    respond.replies(_decisions(spark, sf, observe=True)).write.parquet(path)
    return spark.read.parquet(path).select("seq", "chat_id", "message_id", "sender", *respond.FLAT)


@query
def stored_splits(spark, sf):
    """The labelled dataset through the split sink and scan."""
    path = scratch_path(spark, "splits")
    S.write_splits(_examples(spark, sf), path)
    parts = [S.read_splits(spark, path, split) for split in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "text", "labels.*", "category", "split")


@query
def stored_nested_replies(spark, sf):
    """Nested entries of replies that were written as Parquet and read again."""
    path = scratch_path(spark, "replies")
    respond.replies(_decisions(spark, sf, observe=True)).write.parquet(path)
    return _entries(spark.read.parquet(path))


@query
def array_splits(spark, sf):
    """Splits as files of pretty-printed JSON arrays, a few hundred examples each, read by the split scan."""
    path, examples = scratch_path(spark, "arrays"), _examples(spark, sf)
    pieces = examples.withColumn("piece", F.floor(F.monotonically_increasing_id() / 500)).groupBy("split", "piece").agg(
        F.to_json(F.collect_list(F.struct("text", "labels", "category", "split")), {"pretty": "true"}).alias("value"))
    pieces.persist()
    for split in ("train", "val", "test"):
        pieces.where(F.col("split") == split).select("piece", "value").write.partitionBy("piece").text(f"{path}/{split}.json")
    pieces.unpersist()
    parts = [S.read_split(spark, path, split) for split in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("text", "labels.*", "category", "split")


@query
def label_vectors(spark, sf):
    vector = evaluate.label_vector(F.col("labels"))
    return _examples(spark, sf).select("id", F.array_join(vector.cast("array<int>"), "").alias("vector"))


@query
def default_window_decisions(spark, sf):
    """The default windows, messages only."""
    d = end_to_end.enrich_and_decide(D.messages(spark, sf), None, PolicyParams(), keep=[], observe=False)
    return d.select("seq", "intent", "should_popup", "suppressed_reason", "cooldown_remaining_seconds", "popup_count")


@query
def control_answers(spark, sf):
    return state.control_results(_decisions(spark, sf, keep=[]), D.PARAMS)


@query
def reset_answers(spark, sf):
    d = state.cleared_intents(_decisions(spark, sf, keep=[]))
    return d.withColumn("cleared_intents", F.array_join("cleared_intents", ","))


@query
def flat_replies(spark, sf):
    r = respond.replies(_decisions(spark, sf, observe=True))
    return r.select("seq", "chat_id", "message_id", "sender", *respond.FLAT)


@query
def nested_replies(spark, sf):
    return _entries(respond.replies(_decisions(spark, sf, observe=True)))


def _entries(r):
    entry = F.transform("intents", lambda x: F.concat_ws(
        "/", x["type"], x["confidence"].cast("string"), x["should_popup"].cast("string"),
        x["suppressed_reason"], x["chat_state"], x["payload_json"], x["targeting"]["third_party"],
    ))
    return r.select("seq", F.size("intents").alias("n"), F.array_join(entry, " ").alias("intents"))


@query
def chat_snapshot(spark, sf):
    return state.snapshot(_decisions(spark, sf, keep=[]), F.lit(AS_OF).cast("timestamp"), D.PARAMS)


@query
def chat_states(spark, sf):
    snap = state.snapshot(_decisions(spark, sf, keep=[]), F.lit(AS_OF).cast("timestamp"), D.PARAMS)
    users = D.events(spark, sf).select(F.concat(F.lit("chat_"), (F.col("user_id") % 13).cast("string")).alias("chat_id"))
    asked = state.chat_states(users.distinct(), snap)
    return asked.select(
        "chat_id", "state", "message", F.array_join(F.map_keys("intents"), ",").alias("intents"),
        F.try_element_at("intents", F.lit("money"))["state"].alias("money_state"),
    )


@query
def service_metrics(spark, sf):
    return metrics.service_metrics(_decisions(spark, sf, keep=[]), _accepted(spark, sf))


@query
def intent_counts(spark, sf):
    return metrics.intent_counts(_decisions(spark, sf, keep=[]))


@query
def active_trackers(spark, sf):
    snap = state.snapshot(_decisions(spark, sf, keep=[]), F.lit(AS_OF).cast("timestamp"), D.PARAMS)
    return metrics.active_trackers(snap)


@query
def mean_latency(spark, sf):
    return metrics.mean_latency(D.events(spark, sf).withColumnRenamed("value", "latency_ms"))


@query
def windowed_metrics(spark, sf):
    w = metrics.windowed_metrics(_decisions(spark, sf, keep=[]), "1 day")
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _members(spark, sf):
    known = D.messages(spark, sf).where("chat_id IS NOT NULL AND sender IS NOT NULL")
    return known.select("chat_id", F.col("sender").alias("user")).distinct()


@query
def audience(spark, sf):
    return respond.audience(_decisions(spark, sf), _members(spark, sf))


# -- frames and streams ----------------------------------------------------------------------

def frames_sql(events: str) -> str:
    """Raw JSON frames of the messages: some broken, some with extra fields."""
    return f"""
SELECT seq, ts, CASE seq % 10
    WHEN 0 THEN '{{"text": "' || coalesce(text, '') || '", "chat_id": "' || coalesce(chat_id, '')
    WHEN 1 THEN '{{"chat_id": "' || coalesce(chat_id, '') || '"}}'
    ELSE '{{"text": "' || coalesce(text, '') || '", "chat_id": "' || coalesce(chat_id, '')
      || '", "sender": "' || coalesce(sender, '') || '", "extra": {{"n": ' || cast(seq as varchar(20)) || '}}}}'
    END AS value
FROM ({D.messages_sql(events)}) f
"""


def _frames(spark, sf):
    # only {events} is a hole; braces of the JSON text stay as they are
    return spark.sql(
        frames_sql("@").replace("{", "{{").replace("}", "}}").replace("FROM @", "FROM {events}"),
        events=D.events(spark, sf),
    )


@query
def parsed_frames(spark, sf):
    return S.parse_frames(_frames(spark, sf)).select("seq", "text", "chat_id", "sender", "message_id", "error")


@query
def frame_responses(spark, sf):
    """The full response text of every good frame, and the error frame of the others."""
    parsed = S.parse_frames(_frames(spark, sf))
    good = S.good_frames(parsed)
    d = end_to_end.enrich_and_decide(good, None, D.PARAMS, keep=[*end_to_end.CARRIED, "value"])
    r = respond.replies(d, keep=["value"])
    out = r.select("seq", respond.frame_response(F.col("value"), F.col("intents")).alias("response"))
    bad = parsed.where("error IS NOT NULL").select("seq", F.to_json(F.struct("error")).alias("response"))
    return out.unionByName(bad)


FILES = 4  # per time slice, and per micro-batch
SLICES = ["2024-01-10", "2024-01-20"]


def _arriving(spark, events, cuts=tuple(SLICES)):
    """The events as a file stream: one micro-batch per time slice, in order."""
    path = scratch_path(spark, "events")
    for start, end in zip([None, *cuts], [*cuts, None]):
        _deliver(events, path, start, end)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _deliver(events, path, start=None, end=None):
    if start:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.where(F.col("ts") < F.lit(end).cast("timestamp"))
    events.repartition(FILES).write.mode("append").parquet(path)


def _policy_events(spark, sf, keep=None):
    return policy_events(enrich.fired_intents(D.messages(spark, sf), D.PARAMS, keep="money"), D.controls(spark, sf), keep)


def _run(spark, decided):
    """Decide all that is there; paths of the decisions and of the query's progress."""
    out, progress = scratch_path(spark, "decisions"), scratch_path(spark, "progress")
    ST.start_decisions(decided, out, progress, available_now=True).awaitTermination()
    return out, progress


def _streamed(spark, sf):
    return _run(spark, ST.decide_stream(_arriving(spark, _policy_events(spark, sf)), D.PARAMS))[0]


@query
def stream_decisions(spark, sf):
    """Events in several micro-batches through the stateful query, as a table."""
    return spark.read.parquet(_streamed(spark, sf)).select(*DECISION, "late")


HELD = "seq % 50 = 7 AND ts < TIMESTAMP '2024-01-10' AND chat_id IS NOT NULL"


@query
def stream_late_decisions(spark, sf):
    """The same stream, but some early rows of chats come last, long after the watermark: each is reported as late."""
    return spark.read.parquet(_run(spark, _some_late(spark, sf))[0]).select(*DECISION, "late")


def _some_late(spark, sf):
    events = _policy_events(spark, sf)
    path = scratch_path(spark, "events")
    held = F.coalesce(F.expr(HELD), F.lit(False))
    files = {"early": events.where(~held & (F.col("ts") < SLICES[0])),
             "middle": events.where((F.col("ts") >= SLICES[0]) & (F.col("ts") < SLICES[1])),
             "recent": events.where(F.col("ts") >= SLICES[1]), "late": events.where(held)}
    for part in files.values():
        part.repartition(FILES).write.mode("append").parquet(path)
    return ST.decide_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path), D.PARAMS)


CLOSING = "-1L AS seq, timestamp'2100-01-01' AS ts, '~' AS chat_id"
CONTROL_SLICES = ["2024-01-06", "2024-01-16"]


@query
def live_controls(spark, sf):
    """Messages and controls as two live streams, controls days behind or ahead; each ends with a row that lets all others go."""
    messages = D.messages(spark, sf).unionByName(spark.sql(f"SELECT {CLOSING}, 'bye' AS text"), allowMissingColumns=True)
    controls = D.controls(spark, sf).unionByName(spark.sql(f"SELECT {CLOSING}, 'popup_dismissed' AS kind"), allowMissingColumns=True)
    decided = ST.enrich_stream(
        _arriving(spark, messages), _arriving(spark, controls, CONTROL_SLICES), D.PARAMS, keep=[], watermark="1 hour",
        control_watermark="2 hours", hold=True)
    out = spark.read.parquet(_run(spark, decided)[0])
    return out.where("coalesce(chat_id, '') <> '~'").select(*DECISION, "late")


@query
def live_chat_snapshot(spark, sf):
    """Trackers read from the state store of a query that has seen the events so far."""
    events = _policy_events(spark, sf).where(F.col("ts") <= F.lit(AS_OF).cast("timestamp"))
    _, progress = _run(spark, ST.decide_stream(_arriving(spark, events, SLICES[:1]), D.PARAMS))
    return ST.live_snapshot(spark, progress, F.lit(AS_OF).cast("timestamp"), D.PARAMS)


@query
def stream_from_history(spark, sf):
    """The first part of the history as a batch, the rest as a stream that begins with the batch's trackers."""
    events = _policy_events(spark, sf)
    path = scratch_path(spark, "history")
    decide(events.where(F.col("ts") < SLICES[0]), D.PARAMS).write.parquet(path)
    early = spark.read.parquet(path)
    rest = _arriving(spark, events.where(F.col("ts") >= SLICES[0]), SLICES[1:])
    out, _ = _run(spark, ST.decide_stream(rest, D.PARAMS, initial=state.trackers(early)))
    return early.select(*DECISION, F.lit(False).alias("late")).unionByName(spark.read.parquet(out).select(*DECISION, "late"))


@query
def stream_counters(spark, sf):
    """Counters per day that count late rows too, summed from the parts of all micro-batches."""
    path = scratch_path(spark, "counters")
    ST.start_counters(_some_late(spark, sf), path, scratch_path(spark, "progress"), "1 day", available_now=True).awaitTermination()
    return ST.counters(spark, path).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _served(spark, sf):
    """One query with all its tables, stopped and started again from its checkpoint before the last slice."""
    events = _policy_events(spark, sf, end_to_end.CARRIED)
    path, root, progress = (scratch_path(spark, n) for n in ("events", "service", "progress"))
    for start, end in ((None, SLICES[0]), SLICES, (SLICES[1], None)):
        _deliver(events, path, start, end)
        if start:
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)
            ST.start_service(ST.decide_stream(stream, D.PARAMS), root, progress, D.PARAMS, available_now=True).awaitTermination()
    return root


@query
def stream_control_answers(spark, sf):
    return spark.read.parquet(f"{_served(spark, sf)}/control_answers").drop("epoch")


@query
def stream_reset_answers(spark, sf):
    answers = spark.read.parquet(f"{_served(spark, sf)}/reset_answers").drop("epoch")
    return answers.withColumn("cleared_intents", F.array_join("cleared_intents", ","))


@query
def stream_metrics(spark, sf):
    """Counters per day kept by a second stream that reads the decisions."""
    decided = _streamed(spark, sf)
    schema = spark.read.parquet(decided).schema
    windows = metrics.windowed_metrics(spark.readStream.schema(schema).parquet(decided), "1 day", "40 days")
    out = scratch_path(spark, "metrics")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    windows.writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", scratch_path(spark, "progress")
    ).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("window_start", "intent").agg(F.max_by(
        F.struct("detected", "popups_fired", "popups_suppressed"), "epoch").alias("c"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "intent", "c.*")


@query
def stream_responses(spark, sf):
    """Frames in, response texts out, all as streams."""
    frames = _arriving(spark, _frames(spark, sf))
    good = S.good_frames(S.parse_frames(frames))
    out = scratch_path(spark, "responses")
    decided = ST.enrich_stream(good, None, D.PARAMS, keep=[*end_to_end.CARRIED, "value"])
    ST.start_responses(
        decided, out, scratch_path(spark, "progress"), keep=[], raw="value", available_now=True
    ).awaitTermination()
    return spark.read.parquet(out).select("seq", "response")


# -- evaluation --------------------------------------------------------------------------------

def _multi(spark, sf):
    """Two labels per document with made scores: label as given, score from the length."""
    docs = D.table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    labels = D.table(spark, sf, "labels")
    a = (F.col("doc_id") * 37 + F.col("n_chars")) % 1000 / 1000.0
    b = (F.col("doc_id") * 91 + F.col("n_chars") * 7) % 1000 / 1000.0
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("category"),
        F.array(F.col("quality") * 0.3 + a * 0.7, F.col("toxic") * 0.2 + b * 0.75).alias("probs"),
        F.array("quality", "toxic").alias("labels"),
    )


NAMES2 = ["quality", "toxic"]


@query
def eval_summary(spark, sf):
    r = evaluate.summary(_multi(spark, sf).withColumn("probs", F.transform("probs", lambda p: p * 0.98 + 0.01)))
    return r.select(*[F.round(c, 6).alias(c) for c in ("exact_match", "hamming", "loss")], "examples")


@query
def eval_per_intent(spark, sf):
    r = evaluate.per_intent_report(_multi(spark, sf), NAMES2)
    return r.select("intent", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")], "support")


@query
def stored_report(spark, sf):
    """A training report written as JSON and read with its fallback: it has no accuracy, so the exact match stands in."""
    rows, names = _multi(spark, sf), ["money", "alarm"]
    steps = _history(spark, sf).select("candidate", "val_hamming", *[
        F.col("val_hamming").alias(c) for c in ("train_loss", "val_loss", "val_exact_match")])
    path = scratch_path(spark, "report")
    S.write_report(S.report_row(evaluate.summary(rows), evaluate.per_intent_report(rows, names), steps, model="heads", epochs=5), path)
    r = S.read_report(spark, path)
    told = [F.round(F.col("per_intent")[n][m], 6).alias(f"{n}_{m}") for n in names for m in ("precision", "recall", "f1")]
    return r.select(*[F.round(c, 6).alias(c) for c in ("test_accuracy", "test_exact_match", "test_hamming")], *told,
                    F.col("per_intent.alarm.support").alias("alarm_support"), F.col("per_intent.maps").isNull().alias("maps_untold"))


@query
def label_sets(spark, sf):
    r = _multi(spark, sf)
    pred = evaluate.predictions(F.col("probs"))
    return r.select(
        "id", F.array_join(evaluate.label_names(F.col("labels"), NAMES2), ",").alias("true"),
        F.array_join(evaluate.label_names(pred, NAMES2), ",").alias("predicted"),
    )


@query
def hardest_errors(spark, sf):
    h = evaluate.hardest_errors(_multi(spark, sf), 15, names=NAMES2)
    return h.select(
        "id", "category", F.round("gap", 6).alias("gap"), F.array_join("true", ",").alias("true"),
        F.array_join("predicted", ",").alias("predicted"),
    )


def _binary(spark, sf):
    c = evaluate.cells(_multi(spark, sf), NAMES2)
    return c.where("intent = 'quality'").select("id", "prob", "label", "pred")


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion(_binary(spark, sf))


@query
def class_report(spark, sf):
    r = evaluate.class_report(_binary(spark, sf))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def binary_loss(spark, sf):
    r = evaluate.train_accuracy(_binary(spark, sf).withColumn("prob", F.col("prob") * 0.98 + 0.01))
    return r.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def _history(spark, sf):
    """One candidate per order priority, scored by its share of large orders."""
    o = D.table(spark, sf, "orders")
    return o.groupBy(F.left("o_orderpriority", F.lit(1)).cast("int").alias("candidate")).agg(
        F.round(F.avg((F.col("o_totalprice") > 200000).cast("int")), 2).alias("val_hamming")
    )


@query
def best_candidates(spark, sf):
    h = _history(spark, sf)
    first = evaluate.best_candidate(h).withColumn("rule", F.lit("first"))
    return first.unionByName(evaluate.best_candidate(h, last_of_equals=True).withColumn("rule", F.lit("last")))


@query
def learned_scorer(spark, sf):
    """Five heads trained on keyword labels of the messages, then evaluated on the held-out part."""
    scored = enrich.with_scores(_accepted(spark, sf)).select("seq", "text", "scores")
    flags = {i: (F.get("scores", F.lit(n)) >= 0.5).cast("int") for n, i in enumerate(INTENTS)}
    rows = DS.split_exact(scored.select(F.col("seq").alias("id"), "text", DS.labels_struct(flags).alias("labels")), SEED)
    path = scratch_path(spark, "examples")  # every training step reads them again
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    parts = {s: rows.where(F.col("split") == s) for s in ("train", "val", "test")}
    scorer, _ = learn.search(parts["train"], parts["val"], [0.1, 0.001], features=1 << 12, max_iter=6)
    return evaluate.per_intent_report(learn.eval_rows(scorer, parts["test"]))


@query
def gradient_scorer(spark, sf):
    """Five heads by gradient steps on keyword labels of the messages, scored on the rows they were not trained on."""
    scored = enrich.with_scores(_accepted(spark, sf)).select("seq", "text", "scores")
    flags = {i: (F.get("scores", F.lit(n)) >= 0.5).cast("int") for n, i in enumerate(INTENTS)}
    rows = scored.select("seq", "text", DS.labels_struct(flags).alias("labels"))
    heads = learn.gradient_heads(rows.where("seq % 5 <> 0"))
    test = heads(rows.where("seq % 5 = 0"))
    return test.select("seq", *[F.round(F.get("scores", F.lit(n)), 6).alias(i) for n, i in enumerate(INTENTS)])


# -- datasets ----------------------------------------------------------------------------------

def templates_sql() -> str:
    """Templates made from parts: single, multi and no labels."""
    return """
SELECT category, money, alarm, idx, CASE category
    WHEN 'owing' THEN 'you owe me {amount} for ' || p_name || ' {unknown}'
    WHEN 'mixed_money' THEN '{amount} or {amount} for the ' || p_name
    WHEN 'wake' THEN 'wake me at {place} for ' || p_name
    WHEN 'both' THEN 'pay {amount} at {place}, remind me of ' || p_name
    ELSE p_name || ' from {place}' END AS template
FROM (SELECT p_name, p_partkey % 5 AS c, cast(floor(p_partkey / 5) as bigint) AS idx,
    CASE p_partkey % 5 WHEN 0 THEN 'owing' WHEN 1 THEN 'mixed_money' WHEN 2 THEN 'wake'
      WHEN 3 THEN 'both' ELSE 'none' END AS category,
    CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN 1 ELSE 0 END AS money,
    CASE WHEN p_partkey % 5 IN (2, 3) THEN 1 ELSE 0 END AS alarm
  FROM part) t"""


def fillers_sql() -> str:
    return """
SELECT 'place' AS token, cast(n_nationkey as bigint) AS idx, lower(n_name) AS value FROM nation
UNION ALL
SELECT 'amount', c_custkey, '$' || cast(cast(floor(c_acctbal) as bigint) as varchar(20)) FROM customer"""


def _views(spark, sf, sql, *names):
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM #{n}#")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace(f"#{n}#", "{" + n + "}")
    return spark.sql(sql, **{n: D.table(spark, sf, n) for n in names})


def _templates(spark, sf):
    flags = {i: F.col(i) for i in ("money", "alarm")}
    t = _views(spark, sf, templates_sql(), "part")
    return t.select("category", "template", "idx", DS.labels_struct(flags).alias("labels"))


def _fillers(spark, sf):
    return _views(spark, sf, fillers_sql(), "nation", "customer")


@query
def quotas(spark, sf):
    return DS.quotas(_templates(spark, sf), 600).drop("exact")


@query
def drawn_templates(spark, sf):
    t = _templates(spark, sf)
    return DS.draw_templates(t, DS.quotas(t, 600), SEED).select("id", "category", "template")


@query
def filled_templates(spark, sf):
    t = _templates(spark, sf).withColumn("id", F.concat_ws("#", "category", F.col("idx").cast("string")))
    return DS.fill(t, _fillers(spark, sf), SEED).select("id", "text")


@query
def augmented_messages(spark, sf):
    return _accepted(spark, sf).select("seq", DS.augmented(F.col("text"), F.col("seq"), SEED).alias("text"))


@query
def exact_split(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return DS.split_exact(docs, SEED)


@query
def shuffled_documents(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return docs.withColumn("order_key", DS.shuffle_key(F.col("id"), SEED)).orderBy("order_key")


@query
def quick_split_sizes(spark, sf):
    msgs = _accepted(spark, sf).select(F.col("seq").alias("id"))
    return DS.split_sizes(DS.split_quick(msgs, SEED))


def _examples(spark, sf):
    return DS.build(_templates(spark, sf), _fillers(spark, sf), 600, SEED)


@query
def dataset(spark, sf):
    return _examples(spark, sf).select("id", "text", "labels.*", "category", "split")


@query
def dataset_labels(spark, sf):
    return DS.label_breakdown(_examples(spark, sf))


@query
def dataset_categories(spark, sf):
    return DS.category_histogram(_examples(spark, sf))


@query
def dataset_splits(spark, sf):
    return DS.split_sizes(_examples(spark, sf))


# -- cards and summaries -------------------------------------------------------------------------

@query
def action_cards(spark, sf):
    return respond.summary_cards(respond.action_cards(_fired(spark, sf)))


@query
def popups_per_member(spark, sf):
    members = _members(spark, sf)
    told = ["sender", F.struct("payload.direction").alias("payload"), "targeting"]  # what the rule of an audience reads
    return respond.popups_per_member(_decisions(spark, sf, keep=told), members)


@query
def call_summaries(spark, sf):
    return respond.call_summary(respond.replies(_decisions(spark, sf, observe=True)))
