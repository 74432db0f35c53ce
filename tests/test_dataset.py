"""Dataset building: quotas, filling, noise, splits, counts."""

import re

import pytest
from pyspark.sql import functions as F

from chatsift.config import INTENTS
from chatsift.functions import vocab as V
from chatsift.operators import dataset as DS

SINGLE = {
    "money": ["owing_debt", "bill_splitting", "direct_amount", "venmo_cashapp", "mixed_money"],
    "alarm": ["a1", "a2", "a3", "a4", "a5"], "contact": ["c1", "c2", "c3", "c4"],
    "calendar": ["k1", "k2", "k3", "k4", "k5"], "maps": ["m1", "m2", "m3", "m4", "m5", "m6"],
}


@pytest.fixture(scope="module")
def templates(spark):
    rows = [(c, f"{c} {{amount}} at {{place}} {{nope}}", 0, {i: int(i == intent) for i in INTENTS})
            for intent, cats in SINGLE.items() for c in cats]
    rows += [("multi_intent", f"both {n} {{amount}}{{amount}}", n, {"money": 1, "alarm": 1, "contact": 0, "calendar": 0, "maps": 0})
             for n in range(38)]
    rows += [("none", f"plain {n}", n, dict.fromkeys(INTENTS, 0)) for n in range(7)]
    return spark.createDataFrame(
        [(c, t, n, tuple(m[i] for i in INTENTS)) for c, t, n, m in rows],
        "category string, template string, idx bigint, labels struct<money:int,alarm:int,contact:int,calendar:int,maps:int>",
    )


@pytest.fixture(scope="module")
def fillers(spark):
    rows = [("amount", i, f"${i}") for i in range(50)] + [("place", i, f"place{i}") for i in range(5)]
    return spark.createDataFrame(rows, "token string, idx bigint, value string")


def test_quotas(templates):
    got = {r["category"]: r["quota"] for r in DS.quotas(templates, 600).collect()}
    assert got["owing_debt"] == 120 and got["mixed_money"] == 60 and got["c1"] == 150 and got["m1"] == 100
    assert got["multi_intent"] == 304 and got["none"] == 1622 and sum(got.values()) == 4866


def test_build(templates, fillers):
    made = DS.build(templates, fillers, 600, 7).persist()
    rows = made.collect()
    assert len(rows) == len({r["id"] for r in rows}) == 4866
    sizes = {r["split"]: r["examples"] for r in DS.split_sizes(made).collect()}
    assert sizes == {"train": 3893, "val": 487, "test": 486}
    assert rows != DS.build(templates, fillers, 600, 8).collect()
    again = {r["id"]: r for r in DS.build(templates.repartition(3), fillers, 600, 7).collect()}
    assert all(again[r["id"]] == r for r in rows)
    counts = {r["label"]: r["examples"] for r in DS.label_breakdown(made).collect()}
    assert counts["none"] == 1622 and counts["multi_intent"] == 304 and counts["money"] == 540 + 304
    top = DS.category_histogram(made).first()
    assert (top["category"], top["examples"]) == ("none", 1622)


def test_large_quotas_come_in_blocks(spark, templates):
    plan = spark.createDataFrame([("none", 7, 25_001), ("c1", 1, 0)], "category string, templates bigint, quota bigint")
    drawn = DS.draw_templates(templates, plan, 1)
    assert drawn.count() == drawn.select("id").distinct().count() == 25_001
    assert drawn.select("template").distinct().count() == 7


def test_fill(spark, fillers):
    rows = spark.createDataFrame(
        [(1, "{amount} then {amount} at {place}{place}!"), (2, "no holes"), (3, "{odd} {amount}")], "id int, template string"
    )
    got = {r["id"]: r["text"] for r in DS.fill(rows, fillers, 3).collect()}
    assert re.fullmatch(r"\$\d+ then \$\d+ at place\dplace\d!", got[1])
    first, second = re.findall(r"\$\d+", got[1])
    assert first != second  # independent draws (of 50 values, with this seed)
    assert got[2] == "no holes" and re.fullmatch(r"\{odd\} \$\d+", got[3])


def test_augment(spark):
    text = "Meet me  at the Usual spot"
    rows = spark.range(4000).withColumn("text", F.lit(text))
    got = [r["t"] for r in rows.select(DS.augmented(F.col("text"), F.col("id"), 1).alias("t")).collect()]
    typos = set()
    words = text.split()
    for n, w in enumerate(words):
        if len(w) <= 3:
            typos.add(" ".join(words))
        for i in range(1, len(w) - 1):
            if len(w) > 3:
                typos.add(" ".join([*words[:n], w[:i] + w[i + 1:], *words[n + 1:]]))
    allowed = {text, text.lower(), text.upper(), *(p + text for p in V.AUGMENT_PREFIXES),
               *(text + s for s in V.AUGMENT_SUFFIXES), *typos}
    assert set(got) <= allowed and set(got) & typos
    assert 0.5 < got.count(text) / len(got) < 0.8


def test_split_is_exact(spark):
    rows = spark.range(1003).withColumnRenamed("id", "id")
    for digits in (1, 4):
        got = {r["id"]: r["split"] for r in DS.split_exact(rows, 9, digits=digits).collect()}
        order = [r["id"] for r in rows.orderBy(DS.shuffle_key(F.col("id"), 9)).collect()]
        want = {x: "train" if i / 1003 < 0.8 else "val" if i / 1003 < 0.9 else "test" for i, x in enumerate(order)}
        assert got == want


def test_multi_intent_templates_are_used_exactly_eight_times(spark, templates):
    plan = DS.quotas(templates, 600)
    multi = [r["category"] for r in plan.where("exact").collect()]
    drawn = DS.draw_templates(templates, plan, 7).where(F.col("category").isin(multi))
    counts = drawn.groupBy("category", "template").count().collect()
    assert counts and {r["count"] for r in counts} == {8}
