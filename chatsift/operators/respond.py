"""Replies, audiences, action cards and call summaries from decision rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsift.config import MESSAGE, OBSERVE, scratch_path
from chatsift.functions import links as L
from chatsift.functions import vocab as V

FLAT = [
    "is_money", "confidence", "trigger_type", "direction", "detected_amount", "should_popup",
    "suppressed_reason", "cooldown_remaining_seconds", "chat_state",
]


def intent_entry() -> Column:
    """One entry of a reply's ``intents`` array (with its place in the order)."""
    return F.struct(
        "ordinal", F.col("intent").alias("type"), F.round("confidence", 4).alias("confidence"),
        "should_popup", "suppressed_reason", "cooldown_remaining_seconds", "chat_state",
        "payload", "targeting", "payload_json",
    )


def replies(decisions: DataFrame, keep: list[str] = ("message_id", "sender")) -> DataFrame:
    """One nested reply per message, from decisions that include observe rows.

    Every message has exactly one money row, fired or observed, which gives the
    flat fields; so replies need one regrouping by ``seq`` and no join. A message's rows
    meet in one window: aggregating them before the shuffle would pack and sort
    every entry once more, as they lie in different pieces and nothing comes together there.
    """
    rows = decisions.where(F.col("kind").isin(MESSAGE, OBSERVE))
    fired = F.col("kind") == MESSAGE
    money = F.struct(
        fired.alias("is_money"), F.round("confidence", 4).alias("confidence"),
        F.col("payload.trigger_type").alias("trigger_type"),
        F.col("payload.direction").alias("direction"),
        F.col("payload.amount").alias("detected_amount"),
        F.when(fired, F.col("should_popup")).otherwise(False).alias("should_popup"),
        F.when(fired, F.col("suppressed_reason")).otherwise("not_money").alias("suppressed_reason"),
        F.when(fired, F.col("cooldown_remaining_seconds")).otherwise(0).alias("cooldown_remaining_seconds"),
        "chat_state",
    )
    whole = ["ts", "chat_id", *keep]
    message = Window.partitionBy("seq").orderBy("ordinal")
    all_rows = message.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    grouped = rows.select(
        "seq", "ordinal", *whole, F.when(fired, intent_entry()).alias("entry"), F.when(F.col("intent") == "money", money).alias("money")
    ).select(
        "seq", *whole, F.row_number().over(message).alias("nth"),
        F.array_sort(F.collect_list("entry").over(all_rows)).alias("intents"),
        F.first("money", ignorenulls=True).over(all_rows).alias("m"),
    ).where("nth = 1")
    entries = F.transform("intents", lambda x: x.dropFields("ordinal"))
    return grouped.select("seq", *whole, entries.alias("intents"), *[F.col(f"m.{f}").alias(f) for f in FLAT])


def _entry_json(x: Column) -> Column:
    plain = ["type", "confidence", "should_popup", "suppressed_reason", "cooldown_remaining_seconds", "chat_state"]
    head = F.to_json(F.struct(*[x[f].alias(f) for f in plain]), {"ignoreNullFields": "false"})
    who = F.to_json(x["targeting"], {"ignoreNullFields": "false"})
    return F.concat(
        F.left(head, F.length(head) - 1), F.lit(',"payload":'), x["payload_json"],
        F.lit(',"targeting":'), who, F.lit("}"),
    )


def frame_response(raw: Column, intents: Column) -> Column:
    """The input frame with the flat block and the intents array added.

    The frame's own text is kept, so unknown fields survive unchanged. Only a frame
    that may have one of the added fields already is written anew without it.
    """
    flat = F.to_json(F.struct(*FLAT, F.lit(None).cast("double").alias("latency_ms")), {"ignoreNullFields": "false"})
    taken = F.contains(raw, F.lit('"venmo_detection"')) | F.contains(raw, F.lit('"intents"'))
    others = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda k, _: ~k.isin("venmo_detection", "intents"))
    raw = F.when(taken, F.to_json(others, {"ignoreNullFields": "false"})).otherwise(raw)
    body = F.regexp_replace(raw, r"\}\s*$", "")
    comma = F.when(F.regexp_like(body, F.lit(r"^\s*\{\s*$")), F.lit("")).otherwise(F.lit(","))
    return F.concat(
        body, comma, F.lit('"venmo_detection":'), flat, F.lit(',"intents":['),
        F.array_join(F.transform(intents, _entry_json), ","), F.lit("]}"),
    )


# -- audience -------------------------------------------------------------------

def audience_rule(intent: Column, payload: Column, targeting: Column) -> Column:
    """Whose device acts: everyone, others, sender, addressee or nobody."""
    money = (
        F.when(payload["direction"] == "request", "others")
        .when(payload["direction"] == "offer", "sender")
        .when(payload["direction"] == "split", "everyone")
    )
    rest = (
        F.when(targeting["is_self"], "sender")
        .when(targeting["is_mutual"], "everyone")
        .when(targeting["addressee"].isNotNull(), "addressee")
    )
    return F.coalesce(F.when(intent == "money", money).otherwise(rest), F.lit("nobody"))


def _popups(decisions: DataFrame) -> DataFrame:
    return decisions.where((F.col("kind") == MESSAGE) & F.col("should_popup")).select(
        "seq", "chat_id", "intent", "sender",
        audience_rule(F.col("intent"), F.col("payload"), F.col("targeting")).alias("rule"),
        F.col("targeting.addressee").alias("addressee"),
    ).where(F.col("rule") != "nobody")


# How a popup finds its members: all of the chat, one by name, or one by lower-cased name.
ALL, NAMED, LOWER = "all", "named", "lower"


def _keyed_members(members: DataFrame) -> DataFrame:
    """Three rows per member, one for each way to be found; an unnamed member has no lower-cased name."""
    name = lambda how, c: F.struct(F.lit(how).alias("how"), c.alias("name"))
    user = F.col("user")
    ways = F.array(name(ALL, F.lit("")), name(NAMED, _as_key(user)), name(LOWER, F.concat(F.lit("="), F.lower(user))))
    return members.select("chat_id", "user", F.inline(ways)).where("name is not null")


def _as_key(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def audience(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """The devices that act: one row per popup and chat member concerned.

    One equi-join on (chat, how, name): a popup for one person meets that person only,
    one for the chat its members. Spark broadcasts the members when their size
    allows and splits a hot chat when it does not. For counts alone use
    :func:`popups_per_member`, which never makes these rows.
    """
    rule, sender = F.col("rule"), F.col("sender")
    how = F.when(rule.isin("everyone", "others"), ALL).when(rule == "sender", NAMED).otherwise(LOWER)
    name = F.when(how == ALL, "").when(how == NAMED, _as_key(sender)).otherwise(F.concat(F.lit("="), "addressee"))
    pops = _popups(decisions).withColumns({"how": how, "name": name})
    met = pops.join(_keyed_members(members), ["chat_id", "how", "name"])
    return met.where((rule != "others") | ~F.col("user").eqNullSafe(sender)).select("seq", "chat_id", "intent", "rule", "user")


def popups_per_member(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """How many popups each distinct chat member gets, without listing them.

    Each popup counts for its chat or for a person; one for others counts for the chat
    and, negatively, for its sender. These are summed per (chat, how, name) in one
    aggregation and joined with the members once.
    """
    way = lambda how, name, n: F.struct(F.lit(how).alias("how"), name.alias("name"), F.lit(n).alias("n"))
    rule, sender, whole = F.col("rule"), _as_key(F.col("sender")), F.lit("")
    counts = (
        F.when(rule == "everyone", F.array(way(ALL, whole, 1)))
        .when(rule == "others", F.array(way(ALL, whole, 1), way(NAMED, sender, -1)))
        .when(rule == "sender", F.array(way(NAMED, sender, 1)))
        .otherwise(F.array(way(LOWER, F.concat(F.lit("="), F.col("addressee")), 1)))
    )
    sums = _popups(decisions).select("chat_id", F.inline(counts)).groupBy("chat_id", "how", "name").agg(F.sum("n").alias("n"))
    met = _keyed_members(members.select("chat_id", "user").distinct()).join(sums, ["chat_id", "how", "name"], "left")
    return met.groupBy("chat_id", "user").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("popups"))


# -- cards and summaries ----------------------------------------------------------

def action_cards(decisions: DataFrame) -> DataFrame:
    """Display card of every fired intent, HTML-escaped as shown."""
    i, p, t = F.col("intent"), F.col("payload"), F.col("targeting")
    priority = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in V.SUMMARY_ORDER.items() for x in kv]), i), F.lit(99)
    )
    return decisions.select(
        "seq", "chat_id", "intent", priority.alias("priority"),
        L.percent(F.col("confidence")).alias("confidence"),
        L.escape_html(L.card_title(i, p, t)).alias("title"),
        L.escape_html(L.card_subtitle(i, p, F.col("text"))).alias("subtitle"),
        L.action_link(i, p, t).alias("link"),
    )


def summary_cards(cards: DataFrame) -> DataFrame:
    """Cards in summary order: by chat, intent priority, then arrival.

    A sort reads its input twice, first for the borders of its ranges: the cards are staged, so each is made once.
    """
    spark = cards.sparkSession
    path = scratch_path(spark, "cards")
    cards.write.parquet(path)
    return spark.read.parquet(path).orderBy("chat_id", "priority", "seq")


def call_summary(replies_df: DataFrame) -> DataFrame:
    """Actions, messages and duration per chat."""
    per_chat = replies_df.groupBy("chat_id").agg(
        F.sum(F.size("intents")).alias("actions"),
        F.count("*").alias("messages"),
        F.floor(
            (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000
        ).cast("bigint").alias("duration_seconds"),
    )

    def counted(n: str, noun: str) -> Column:
        return F.concat(F.col(n).cast("string"), F.lit(f" {noun}"), F.when(F.col(n) == 1, "").otherwise("s"))

    return per_chat.withColumns({
        "duration": L.minutes_seconds(F.col("duration_seconds")),
        "title": F.concat(counted("actions", "action"), F.lit(" to follow up on")),
        "stats": F.concat(
            counted("messages", "message"), F.lit(" · "),
            L.minutes_seconds(F.col("duration_seconds")), F.lit(" duration"),
        ),
    })
