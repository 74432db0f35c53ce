"""Keyed histories as native plans: idle sessions and as-of joins.

Both depend on what came before within a key, which a window over the key would
sort in one task however hot the key is. Here histories are cut into pieces of time:
windows run inside a piece, one small row per piece tells what later pieces need,
a window over those rows carries it on, and a join brings it back to the pieces,
whose partitioning by (key, piece) is still there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatsift.operators.decision import SECOND

DAY = 86_400


def _us(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _whole(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def sessions(events: DataFrame, idle_seconds: int, keys: list[str], *, ts: str = "ts", seq: str = "seq",
             out: str = "session", piece_seconds: int = DAY) -> DataFrame:
    """events with the number (from 1) of their session: a key's rows up to a pause longer than ``idle_seconds``.

    Order: time, then ``seq``. A tracker is dropped after such a pause, so sessions of
    one key need nothing of each other. Rows without a key or a time get null.
    """
    idle, names = idle_seconds * SECOND, events.columns
    rows = events.withColumns({"_us": _us(ts), "_piece": F.floor(_us(ts) / (piece_seconds * SECOND))})
    known = _whole(keys) & F.col("_us").isNotNull()
    within = Window.partitionBy(*keys, "_piece").orderBy("_us", seq)
    inside = rows.where(known).withColumn("_gap", F.col("_us") - F.lag("_us").over(within)).withColumn(
        "_cuts", F.sum(F.when(F.col("_gap") > idle, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = inside.groupBy(*keys, "_piece").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_cuts").alias("_all"))
    order = Window.partitionBy(*keys).orderBy("_piece")
    opens = F.when(F.col("_first") - F.lag("_last").over(order) <= idle, 0).otherwise(1)
    before = F.sum(F.col("_open") + F.col("_past")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    starts = pieces.withColumns({"_open": opens, "_past": F.coalesce(F.lag("_all").over(order), F.lit(0))}).withColumn("_base", before)
    numbered = inside.join(starts.select(*keys, "_piece", "_base"), [*keys, "_piece"]).withColumn(out, F.col("_base") + F.col("_cuts"))
    return numbered.select(*names, out).unionByName(rows.where(~known).select(*names, F.lit(None).cast("long").alias(out)))


def session_totals(numbered: DataFrame, keys: list[str], *, ts: str = "ts", session: str = "session") -> DataFrame:
    """One row per session: events, first and last time, seconds between."""
    return numbered.where(F.col(session).isNotNull()).groupBy(*keys, session).agg(
        F.count("*").alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"),
        F.floor((F.max(_us(ts)) - F.min(_us(ts))) / SECOND).alias("seconds"),
    )


def as_of(left: DataFrame, history: DataFrame, keys: list[str], values: list[str], *, ts: str = "ts", seq: str = "seq",
          inclusive: bool = False, out: str = "known", piece_seconds: int = DAY) -> DataFrame:
    """left with a struct of ``values`` of the latest row of history with the same keys before it, null if there is none.

    Order: time, then ``seq``; a history row of the same time and number counts if
    ``inclusive``, and of several such rows any one. Left rows without a key or a time know nothing.
    """
    order = ["_us", seq, "_side"]
    first, second = (0, 1) if inclusive else (1, 0)

    def side(df: DataFrame, place: int, row: Column, known: Column) -> DataFrame:
        return df.where(_whole([*keys, ts])).select(
            *keys, _us(ts).alias("_us"), F.col(seq), F.lit(place).alias("_side"), row.alias("_row"), known.alias("_known"))

    kind = history.select(F.struct(*values).alias("k")).schema["k"].dataType
    row = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType
    both = side(left, second, F.struct(*left.columns), F.lit(None).cast(kind)).unionByName(
        side(history, first, F.lit(None).cast(row), F.struct(*values))
    ).withColumn("_piece", F.floor(F.col("_us") / (piece_seconds * SECOND)))
    within = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_here", F.last("_known", ignorenulls=True).over(within))
    pieces = both.groupBy(*keys, "_piece").agg(F.max_by("_known", F.when(F.col("_known").isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*keys, "_piece", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    told = inside.where(F.col("_row").isNotNull()).join(carried, [*keys, "_piece"]).select(
        "_row.*", F.coalesce("_here", "_before").alias(out))
    return told.unionByName(left.where(~_whole([*keys, ts])).withColumn(out, F.lit(None).cast(kind)))
