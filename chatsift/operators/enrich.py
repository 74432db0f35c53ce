"""Messages to fired intents: reject, score, threshold, payload, targeting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.config import DISMISSED, INTENTS, PAYMENT, RESET, PolicyParams
from chatsift.functions import payload as P
from chatsift.functions import scoring, targeting
from chatsift.functions.text import is_blank
from chatsift.functions.timephrase import with_time_phrase


def accept_messages(messages: DataFrame) -> DataFrame:
    return messages.where(~is_blank(F.col("text")))


def reject_messages(messages: DataFrame) -> DataFrame:
    """The complement of :func:`accept_messages`, with the reason."""
    return messages.where(is_blank(F.col("text"))).withColumn("reason", F.lit("text required"))


def _known_intent() -> Column:
    return F.col("intent").isNull() | F.col("intent").isin(INTENTS)


def accept_controls(controls: DataFrame) -> DataFrame:
    return controls.where(_known_intent())


def reject_controls(controls: DataFrame) -> DataFrame:
    return controls.where(~_known_intent()).withColumn("reason", F.lit("unknown intent"))


def with_scores(messages: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``scores`` (five doubles in intent order).

    ``scorer`` replaces the keyword rules: a function that adds the column,
    e.g. a learned model or a batch-inference UDF.
    """
    if scorer is not None:
        return scorer(messages).withColumn("_low", F.lower("text"))
    low = messages.withColumn("_low", F.lower("text"))
    return low.withColumn("scores", scoring.keyword_scores(F.col("text"), F.col("_low")))


def explode_scores(scored: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per message and intent: ``intent``, ``ordinal``, ``confidence``.

    ``keep`` picks the cells to emit. It acts inside the array: a filter on
    exploded rows would make five rows of each message first, and one on the
    scores would be pushed below them and compute them twice.
    """
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("intent"), F.lit(i).alias("ordinal"),
            F.get("scores", F.lit(i)).alias("confidence"),
        )
        for i, name in enumerate(INTENTS)
    ])
    if keep is None:
        return scored.select("*", F.inline(cells))
    # outer: Spark derives no filter from it that would repeat the scoring
    return scored.select("*", F.inline_outer(F.filter(cells, keep))).where(F.col("intent").isNotNull())


def fired_intents(
    messages: DataFrame,
    params: PolicyParams = PolicyParams(),
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    keep: str = "fired",
) -> DataFrame:
    """Long table of intents at or above the threshold, with payload and targeting.

    ``keep="money"`` also keeps a bare row for every message whose money score
    stays below the threshold (``fired`` false); replies need the money state
    at that moment.
    """

    def wanted(cell: Column) -> Column:
        fired = cell["confidence"] >= params.threshold
        return fired | (cell["intent"] == "money") if keep == "money" else fired

    scored = with_scores(accept_messages(messages), scorer)
    cells = explode_scores(scored, wanted).drop("scores")
    cells = cells.withColumn("fired", F.col("confidence") >= params.threshold)
    timed = with_time_phrase(
        cells, "text", "ts", when=F.col("fired") & F.col("intent").isin("alarm", "calendar")
    )
    out = P.with_payload(targeting.with_targeting(timed, when=F.col("fired")))
    if keep != "money":
        out = out.drop("fired")
    return out.drop("_low", "time_iso", "time_phrase")


def keyed_controls(controls: DataFrame) -> DataFrame:
    """Controls as one row per (chat, intent) they touch.

    Payments touch money; a dismissal without intent means money; a reset
    without intent becomes one row per intent, marked ``scoped`` false.
    """
    ok = accept_controls(controls)
    targets = (
        F.when(F.col("kind") == PAYMENT, F.array(F.lit("money")))
        .when(F.col("kind") == DISMISSED, F.array(F.coalesce("intent", F.lit("money"))))
        .when(F.col("intent").isNull(), F.array(*[F.lit(i) for i in INTENTS]))
        .otherwise(F.array("intent"))
    )
    scoped = ~((F.col("kind") == RESET) & F.col("intent").isNull())
    return ok.select(
        "seq", "ts", "chat_id", "kind", F.explode(targets).alias("intent"),
        F.nullif("amount", F.lit("")).alias("amount"), scoped.alias("scoped"),
    )
