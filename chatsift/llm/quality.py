"""Operator 9: quality rules joined by weak supervision. DataFrame functions only.

Counts of a text give rules that vote good (1), bad (-1) or abstain (0). How often a
rule votes bad on good and on bad texts isn't known; expectation maximisation finds
it from how the rules agree over all documents: votes are counted by pattern (at most
3 to the number of rules), and the iterations run over that small table in one
expression. A document is kept if its posterior probability of being good is at least
one half, and if it does not fail the two base limits. Null and empty texts have no
words, fail and are not kept; rows are judged one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import read, staged

WINDOW = 8
WORD = "[^ \t-\r]+"
WORDS_LEAST, REPEAT_MOST = 20, 30
ROUNDS = 40
#: Votes added to the counts of each rule, as a share of all documents: bad votes on bad and on good texts.
WEIGHT, BAD_ON_BAD, BAD_ON_GOOD = 0.02, 0.5, 0.01


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (
            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = let(pairs, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        steps = lambda p: F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return let(places, lambda p: F.aggregate(steps(p), F.lit(WINDOW), lambda total, x: total + x))

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n > WINDOW, found).otherwise(F.lit(0)).cast("long")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with its counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, text.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    return rows.select(
        *others,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__text", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("__text", "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("__text", "[\\p{L}\\p{N}\\s]+", "")).cast("long").alias("n_marks"),
        F.length("__text").cast("long").alias("n_all"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        F.regexp_count("__text", F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
    )


def rules() -> dict[str, Column]:
    """Votes by name: 1 good, -1 bad, 0 no opinion."""
    c = F.col

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    words, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))
    return {
        "length": vote(c("n_words") >= 40, c("n_words") < WORDS_LEAST),
        "word_length": vote((c("word_chars") >= 3 * words) & (c("word_chars") <= 12 * words), (c("word_chars") < 2 * words) | (c("word_chars") > 20 * words)),
        "symbols": vote(50 * c("n_symbols") <= words, 10 * c("n_symbols") > words),
        "lines": vote(c("n_dup_lines") == 0, 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": vote(20 * c("n_repeat_words") <= words, 100 * c("n_repeat_words") > 20 * words),
        "capitals": vote(5 * c("n_upper") <= letters, 2 * c("n_upper") > letters),
        "shouts": vote(200 * c("n_shouts") <= words, 10 * c("n_shouts") > words),
        "letters": vote(3 * c("n_letters") >= 2 * c("n_all"), 2 * c("n_letters") < c("n_all")),
        "marks": vote(16 * c("n_marks") <= c("n_all"), 10 * c("n_marks") > c("n_all")),
        "variety": vote((10 * c("n_distinct") >= 4 * words) | (c("n_words") > 400), (10 * c("n_distinct") < 2 * words) & (c("n_words") <= 2000)),
    }


def learned(votes: DataFrame) -> tuple[float, list[float], list[float]]:
    """Share of good texts, and each rule's share of bad votes on bad and on good texts, by EM.

    votes: column ``votes`` (array of -1, 0, 1). All iterations are one expression
    over the patterns, of which there are at most 3 to the number of rules.
    """
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"), F.sum("n").alias("total"))
    each = F.get(F.col("patterns"), F.lit(0))["votes"]

    def good(model: Column, v: Column) -> Column:
        terms = F.zip_with(
            v, F.arrays_zip(model["bad"].alias("bad"), model["good"].alias("good")),
            lambda x, m: F.when(x == -1, F.log(m["good"] / m["bad"])).when(x == 1, F.log((1 - m["good"]) / (1 - m["bad"]))).otherwise(0.0),
        )
        odds = F.aggregate(terms, F.log(model["share"] / (1 - model["share"])), lambda a, t: a + t)
        return 1 / (1 + F.exp(-odds))

    def step(model: Column, _: Column) -> Column:
        judged = F.transform(F.col("patterns"), lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), good(model, p["votes"]).alias("q")))

        def rate(rows: Column, on_good: bool, prior: float) -> Column:
            part = lambda p: p["n"] * (p["q"] if on_good else 1 - p["q"])
            total = lambda keep: F.aggregate(
                rows, F.lit(0.0), lambda a, p: a + F.when(keep(p), part(p)).otherwise(0.0))
            weight = F.col("total") * WEIGHT + 1
            of = lambda i: (total(lambda p: F.get(p["votes"], i) == -1) + weight * prior) / (total(lambda p: F.get(p["votes"], i) != 0) + weight)
            return F.transform(each, lambda _v, i: of(i))

        return let(judged, lambda rows: F.struct(
            F.least(F.greatest(F.aggregate(rows, F.lit(0.0), lambda a, p: a + p["n"] * p["q"]) / F.col("total"), F.lit(0.05)), F.lit(0.95)).alias("share"),
            rate(rows, False, BAD_ON_BAD).alias("bad"), rate(rows, True, BAD_ON_GOOD).alias("good"),
        ))

    start = F.struct(
        F.lit(0.8).alias("share"), F.transform(each, lambda v: F.lit(BAD_ON_BAD)).alias("bad"), F.transform(each, lambda v: F.lit(BAD_ON_GOOD)).alias("good")
    )
    model = row.where("total is not null").select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("m")).first()
    if model is None:
        n = len(rules())
        return 0.8, [BAD_ON_BAD] * n, [BAD_ON_GOOD] * n
    return model.m.share, list(model.m.bad), list(model.m.good)


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with counts, quality (posterior), base_failed and kept."""
    counts = counted(docs, text_col)
    rows = staged(counts.withColumn("votes", F.array(*[v.cast("int") for v in rules().values()])), "quality")
    share, bad, good = learned(rows.select("votes"))
    odds = F.lit(math.log(share / (1 - share)))
    for i, (b, g) in enumerate(zip(bad, good)):
        vote = F.get("votes", F.lit(i))
        odds = odds + F.when(vote == -1, math.log(g / b)).when(vote == 1, math.log((1 - g) / (1 - b))).otherwise(0.0)
    failed = (F.col("n_words") < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEAT_MOST * F.col("n_words"))
    return rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    return judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


#: The rules in SQL: good, bad.
_RULES = [
    ("n_words >= 40", f"n_words < {WORDS_LEAST}"),
    ("word_chars >= 3 * nw AND word_chars <= 12 * nw", "word_chars < 2 * nw OR word_chars > 20 * nw"),
    ("50 * n_symbols <= nw", "10 * n_symbols > nw"),
    ("n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("20 * n_repeat_words <= nw", "100 * n_repeat_words > 20 * nw"),
    ("5 * n_upper <= nl", "2 * n_upper > nl"),
    ("200 * n_shouts <= nw", "10 * n_shouts > nw"),
    ("3 * n_letters >= 2 * n_all", "2 * n_letters < n_all"),
    ("16 * n_marks <= n_all", "10 * n_marks > n_all"),
    ("10 * n_distinct >= 4 * nw OR n_words > 400", "10 * n_distinct < 2 * nw AND n_words <= 2000"),
]


def _em_sql(rounds: int = ROUNDS) -> str:
    """The iterations of ``learned``, one pair of tables each; patterns ``pt`` (votes, n) to a model m<rounds>."""
    n = len(_RULES)
    every = f"range(1, {n + 1})"
    odds = (f"ln(share / (1 - share)) + list_sum(list_transform({every}, lambda i: CASE votes[i] WHEN -1 THEN ln(good[i] / bad[i])"
            " WHEN 1 THEN ln((1 - good[i]) / (1 - bad[i])) ELSE 0 END))")
    rate = lambda i, part, prior: (
        f"(coalesce(sum({part}) FILTER (votes[{i}] = -1), 0) + max(w) * {prior}) / (coalesce(sum({part}) FILTER (votes[{i}] <> 0), 0) + max(w))")
    tables = [f"m0 AS (SELECT 0.8::DOUBLE AS share, list_transform({every}, lambda i: {BAD_ON_BAD}::DOUBLE) AS bad,"
              f" list_transform({every}, lambda i: {BAD_ON_GOOD}::DOUBLE) AS good, sum(n) * {WEIGHT} + 1 AS w, sum(n) AS total FROM pt)"]
    for k in range(rounds):
        tables.append(f"q{k} AS MATERIALIZED (SELECT votes, n, w, total, 1 / (1 + exp(-({odds}))) AS q FROM pt, m{k})")
        bad = ", ".join(rate(i, "n * (1 - q)", BAD_ON_BAD) for i in range(1, n + 1))
        good = ", ".join(rate(i, "n * q", BAD_ON_GOOD) for i in range(1, n + 1))
        tables.append(f"m{k + 1} AS MATERIALIZED (SELECT least(greatest(sum(n * q) / max(total), 0.05), 0.95) AS share,"
                      f" [{bad}] AS bad, [{good}] AS good, max(w) AS w, max(total) AS total FROM q{k})")
    tables.append(f"judged AS (SELECT *, 1 / (1 + exp(-({odds}))) AS quality FROM voted, m{rounds})")
    return ", ".join(tables)


OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) x
),
windows AS (SELECT r, i, ws[i : i + {WINDOW - 1}] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) > {WINDOW}) x),
often AS (SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, win HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM often) x GROUP BY r),
counted AS (
  SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS n_marks,
    length(t) AS n_all, len(list_distinct(ws)) AS n_distinct, len(regexp_extract_all(t, '[!?]{{2,}}')) AS n_shouts,
    greatest(len(ws), 1) AS nw, greatest(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')), 1) AS nl
  FROM d LEFT JOIN covered USING (r)
),
voted AS MATERIALIZED (SELECT *, [{', '.join(f'CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END' for good, bad in _RULES)}] AS votes FROM counted),
pt AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY votes),
{_em_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND quality >= 0.5 AS kept, quality
FROM (SELECT *, n_words < {WORDS_LEAST} OR 100 * n_repeat_words > {REPEAT_MOST} * n_words AS failed FROM judged) x
"""
