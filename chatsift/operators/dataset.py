"""Labelled datasets from templates: draw, fill, augment, split, count.

All choices come from md5(seed, row, purpose), so they do not depend on
partitioning and a lost task redraws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatsift.config import INTENTS, LABELS_TYPE
from chatsift.functions import vocab as V

BLOCK = 10_000
HOLE = r"\{(\w+)\}"


def draw(seed: int, row: Column, purpose: str) -> Column:
    """A whole number in [0, 2^32) that depends on all three arguments."""
    text = F.concat(F.lit(f"{seed}|"), row.cast("string"), F.lit(f"|{purpose}"))
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint")


def uniform(seed: int, row: Column, purpose: str) -> Column:
    return draw(seed, row, purpose) / F.lit(2.0**32)


def pick(seed: int, row: Column, purpose: str, n: Column) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(draw(seed, row, purpose), n.cast("bigint"))


def labels_struct(flags: dict[str, Column]) -> Column:
    """All five labels, 0 where no flag is given."""
    return F.struct(*[
        F.coalesce(flags[i], F.lit(0)).cast("int").alias(i) if i in flags else F.lit(0).alias(i)
        for i in INTENTS
    ])


def _label_sum(labels: Column) -> Column:
    return sum((labels[i] for i in INTENTS[1:]), labels[INTENTS[0]])


# -- quotas and draws ---------------------------------------------------------------

def quotas(templates: DataFrame, n_per_intent: int = 600) -> DataFrame:
    """Examples to draw per category: (category, templates, quota, exact).

    An intent's share is split evenly over its categories (mixed money gets
    half a share), every multi-intent template is used eight times exactly
    (``exact``), and negatives, which form one category, come to half of all
    positives. A category that mixes kinds has the kind with the most labels.
    """
    kind = F.when(F.col("most") == 0, "none").when(F.col("most") > 1, "multi").otherwise("single")
    intent = F.coalesce(*[F.when(F.col(f"labels.{i}") == 1, i) for i in INTENTS])
    groups = templates.groupBy("category").agg(
        F.count("*").alias("templates"), F.max(_label_sum(F.col("labels"))).alias("most"), F.min(intent).alias("intent")
    ).withColumn("kind", kind).drop("most")
    peers = groups.where("kind = 'single'").groupBy("intent").agg(F.count("*").alias("peers"))
    shares = F.when(F.col("category") == "mixed_money", 2 * F.col("peers")).otherwise(F.col("peers"))
    quota = F.when(F.col("kind") == "multi", 8 * F.col("templates")).when(
        F.col("kind") == "single", F.floor(F.lit(n_per_intent) / shares)
    )
    sized = groups.join(peers, "intent", "left").withColumn("quota", quota.cast("bigint"))
    half = sized.agg(
        F.lit("none").alias("kind"), F.floor(F.sum("quota") * 0.5).cast("bigint").alias("negatives")
    )
    return sized.join(half, "kind", "left").select(
        "category", "templates", F.coalesce("quota", "negatives").alias("quota"), (F.col("kind") == "multi").alias("exact")
    )


def draw_templates(templates: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``quota`` rows per category, each with a template drawn by hash, or in turn where exact.

    ``templates`` carries ``idx``, its place in the category from 0. Rows are
    made in two steps of bounded arrays so that a large quota spreads out.
    """
    if "exact" not in plan.columns:
        plan = plan.withColumn("exact", F.lit(False))
    blocks = plan.where("quota > 0").select(
        "category", "templates", "quota", "exact",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / BLOCK).cast("bigint"))).alias("block"),
    )
    first = F.col("block") * BLOCK
    last = F.least(F.col("quota"), first + BLOCK) - 1
    rows = blocks.repartition("category", "block").select(
        "category", "templates", "exact", F.explode(F.sequence(first, last)).alias("i")
    )
    row = F.concat(F.col("category"), F.lit("#"), F.col("i").cast("string"))
    rows = rows.select(
        row.alias("id"), "category",
        F.when(F.col("exact"), F.col("i") % F.col("templates")).otherwise(pick(seed, row, "template", F.col("templates"))).alias("idx"),
    )
    return rows.join(templates, ["category", "idx"]).drop("idx")


# -- filling ------------------------------------------------------------------------

def fill(rows: DataFrame, fillers: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """Replace each ``{token}`` of ``template`` by an independent draw: ``text``.

    ``fillers`` is (token, idx from 0, value). Unknown tokens stay as written.
    The fillers join on (token, idx): broadcast by Spark while small, and
    spread evenly by the hash when not.
    """
    holes = rows.select(
        id_col, F.posexplode(F.regexp_extract_all("template", F.lit(HOLE), F.lit(1))).alias("pos", "token")
    )
    sizes = fillers.groupBy("token").agg(F.count("*").alias("_n"))
    key = F.concat(F.col(id_col).cast("string"), F.lit("@"), F.col("pos").cast("string"))
    drawn = holes.join(sizes, "token", "left").withColumn(
        "idx", F.when(F.col("_n").isNotNull(), pick(seed, key, "filler", F.col("_n")))
    )
    valued = drawn.join(fillers, ["token", "idx"], "left").select(
        id_col, "pos", F.coalesce("value", F.concat(F.lit("{"), F.col("token"), F.lit("}"))).alias("value")
    )
    # as many entries per row as its template has holes
    per_row = valued.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v"))
    parts = F.split("template", r"\{\w+\}")
    pieces = F.zip_with(
        parts, F.coalesce("_v", F.array().cast("array<struct<pos:int,value:string>>")),
        lambda p, v: F.concat(F.coalesce(p, F.lit("")), F.coalesce(v["value"], F.lit(""))),
    )
    return rows.join(per_row, id_col, "left").withColumn("text", F.array_join(pieces, "")).drop("_v")


# -- augmenting -----------------------------------------------------------------------

def augmented(text: Column, row: Column, seed: int) -> Column:
    """One of up to six variants of the text, drawn uniformly."""
    odds = V.AUGMENT_ODDS

    def chance(name: str) -> Column:
        return uniform(seed, row, name) < odds[name]

    def one_of(values: list[str], purpose: str) -> Column:
        options = F.array(*[F.lit(v) for v in values])
        return F.get(options, pick(seed, row, purpose, F.lit(len(values))).cast("int"))

    variants = F.array_compact(F.array(
        text,
        F.when(chance("lower"), F.lower(text)),
        F.when(chance("upper"), F.upper(text)),
        F.when(chance("prefix"), F.concat(one_of(V.AUGMENT_PREFIXES, "which prefix"), text)),
        F.when(chance("suffix"), F.concat(text, one_of(V.AUGMENT_SUFFIXES, "which suffix"))),
        F.when(chance("typo"), with_typo(text, row, seed)),
    ))
    return F.get(variants, pick(seed, row, "variant", F.size(variants)).cast("int"))


def with_typo(text: Column, row: Column, seed: int) -> Column:
    """Words joined by one space, an inner letter of one word longer than 3 dropped."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    at = pick(seed, row, "word", F.size(words)).cast("int")
    word = F.get(words, at)
    cut = F.lit(1) + pick(seed, row, "letter", F.greatest(F.length(word) - 2, F.lit(1))).cast("int")
    dropped = F.concat(F.left(word, cut), F.substr(word, cut + 2))
    changed = F.when(F.length(word) > 3, dropped).otherwise(word)
    joined = F.concat_ws(
        " ", F.slice(words, F.lit(1), at), F.array(changed), F.slice(words, at + 2, F.size(words))
    )
    return F.when(F.trim(text) != "", joined)


# -- splitting ------------------------------------------------------------------------

def shuffle_key(row: Column, seed: int) -> Column:
    """Sorting by this is a seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row.cast("string")))


def split_exact(rows: DataFrame, seed: int, id_col: str = "id", digits: int = 4) -> DataFrame:
    """Exact 80/10/10 split by position in the seeded order.

    The order is cut into 16^digits ranges by the leading hash digits. Counting
    them shows which range holds each border; ranking that one range gives the
    border's exact place. All rows are then compared with the two borders, so
    the rows themselves are neither sorted nor shuffled.
    """
    place = F.struct(shuffle_key(F.col(id_col), seed).alias("h"), F.col(id_col).alias("i"))
    keys = rows.select(place.alias("at")).withColumn("b", F.left("at.h", F.lit(digits)))
    # at most 16^digits rows
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = keys.groupBy("b").agg(F.count("*").alias("c")).select(
        "b", (F.sum("c").over(upto) - F.col("c")).alias("first"), (F.sum("c").over(upto) - 1).alias("last"),
        F.sum("c").over(Window.partitionBy()).alias("n"),
    )
    shares = {"val": 0.80, "test": 0.90}
    reached = ranges.groupBy().agg(*[
        F.min(F.when(F.col("last") / F.col("n") >= s, F.struct("b", "first", "n"))).alias(k)
        for k, s in shares.items()
    ])
    holders = reached.select(F.explode(F.array_distinct(F.array("val", "test"))).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("b").orderBy("at")) - 1
    ranked = keys.join(F.broadcast(holders), "b").withColumn("ratio", (F.col("first") + rank) / F.col("n"))
    one = F.lit(1).alias("_one")
    borders = ranked.agg(*[
        F.min(F.when(F.col("ratio") >= s, F.col("at"))).alias(f"_{k}") for k, s in shares.items()
    ]).select(one, "_val", "_test")
    side = (
        F.when(F.col("_val").isNull() | (F.col("_at") < F.col("_val")), "train")
        .when(F.col("_test").isNull() | (F.col("_at") < F.col("_test")), "val").otherwise("test")
    )
    # `borders` is one row
    placed = rows.drop("split").select("*", place.alias("_at"), one).join(F.broadcast(borders), "_one")
    return placed.withColumn("split", side).drop("_at", "_one", "_val", "_test")


def split_quick(rows: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """About 80/10/10 by hash alone: no counting, and new rows never move old ones."""
    u = uniform(seed, F.col(id_col), "split")
    return rows.withColumn("split", F.when(u < 0.80, "train").when(u < 0.90, "val").otherwise("test"))


def build(templates: DataFrame, fillers: DataFrame, n_per_intent: int = 600, seed: int = 42) -> DataFrame:
    """Draw, fill, augment and split: a labelled dataset."""
    negative = _label_sum(F.col("labels")) == 0
    pool = templates.withColumn("category", F.when(negative, "none").otherwise(F.col("category")))
    rows = draw_templates(pool, quotas(pool, n_per_intent), seed)
    filled = fill(rows, fillers, seed)
    noisy = filled.withColumn("text", augmented(F.col("text"), F.col("id"), seed))
    return split_exact(noisy.select("id", "text", F.col("labels").cast(LABELS_TYPE), "category"), seed)


# -- counting -------------------------------------------------------------------------

def label_breakdown(examples: DataFrame) -> DataFrame:
    """Positives per intent, negatives and multi-intent examples."""
    total = _label_sum(F.col("labels"))
    wide = examples.agg(
        *[F.coalesce(F.sum(F.col(f"labels.{i}")), F.lit(0)).alias(i) for i in INTENTS],
        F.count_if(total == 0).alias("none"), F.count_if(total >= 2).alias("multi_intent"),
    )
    names = [*INTENTS, "none", "multi_intent"]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("label"), F.col(n).cast("bigint").alias("examples")) for n in names
    ])))


def category_histogram(examples: DataFrame) -> DataFrame:
    return examples.groupBy("category").agg(F.count("*").alias("examples")).orderBy(F.desc("examples"), "category")


def split_sizes(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split").agg(F.count("*").alias("examples"))
