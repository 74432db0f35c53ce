"""Operator 10: secret scans with linking of credential parts. DataFrame functions only.

Base spans are matches of three patterns (assign, access, hex) that pass their length.
Weak candidates are parts that alone say little: an identifier (capitals and digits), a
secret (a long mixed token) or an endpoint (an address). Every part, base spans
included, has a scope, REACH characters to either side of it. Parts are joined where
their scopes meet, in buckets of text of that width, and a weak candidate is reported
only if the parts that complement it are there: a secret with an identifier, an
identifier with a secret, an endpoint with both. A bucket has room for few parts, so a
long text with many parts costs in proportion. Candidates that overlap a base span are
left out. Null and empty texts have no spans; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import read, staged

REACH = 200

BASE = ["assign", "access", "hex"]
WEAK = ["identifier", "secret", "endpoint"]
KINDS = BASE + WEAK
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

# The base patterns. Runs of hex digits and of capitals are matched from
# their least length on, which finds the same spans as matching all and dropping short ones.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE_LEAST = 6

SPANS = "array<struct<start:int,end:int,kind:string>>"

#: Candidates: addresses up to their query, and tokens of 16 characters or more from their
#: first character on. A token has = only as padding at its end, so the value of name=value
#: is one of its own; its name is one only if it is bare letters and digits.
WEAK_PATTERN = (
    r"""(?<![A-Za-z0-9+/_.-])(?:https?://(?=[^\s"'<>]{4})[^\s"'<>?#]+"""
    r"""|[a-z0-9-][a-z0-9.-]*\.(?:amazonaws|azure|windows|googleapis)\.(?:com|net)"""
    r"""|(?=[A-Za-z+/_-]*[0-9])(?:[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/]{16,}+(?==+[A-Za-z0-9+/_-])))"""
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column) -> Column:
    """Sums of an array's numbers up to each place, in log2 rounds that add what stands 1, 2, 4 ... places before."""
    before = lambda a, i, k: F.coalesce(F.get(a, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))

    def summed(a: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)
        return F.when(F.size(a) > 1, F.aggregate(rounds, a, lambda a, k: F.transform(a, lambda x, i: x + before(a, i, k)))).otherwise(a)

    return let(numbers.cast("array<int>"), summed)


def found(text: Column, pattern: str, kind: Column | str, keep=None, group: int = 0) -> Column:
    """Array of (start, end, kind) of the matches in text, in characters; ``keep`` tests the text of a group.

    The places follow from the lengths of the pieces between matches. Texts
    without a match cost one search, others little more than in proportion to their matches.
    """
    named = kind if callable(kind) else lambda _: F.lit(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    pieces = F.split(text, pattern, -1)
    rows = F.filter(
        F.arrays_zip(pieces.alias("piece"), matches.alias("whole"), tested.alias("tested")), lambda r: r["whole"].isNotNull()
    )

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.length(r["piece"]) + F.length(r["whole"])))
        spans = F.zip_with(rows, ends, lambda r, end: F.struct(
            (end - F.length(r["whole"])).alias("start"), end.alias("end"), named(r["whole"]).alias("kind"),
            (keep(r["tested"]) if keep else F.lit(True)).alias("kept"),
        ))
        return F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    none = F.array().cast(SPANS)
    return F.when(text.rlike(pattern), let(rows, placed).cast(SPANS)).otherwise(none)


def weak_kind(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^https?://|\.(com|net)$"), "endpoint")
        .when(token.rlike(r"^[A-Z0-9_]{16,40}$"), "identifier").otherwise("secret")
    )


def strong_token(token: Column) -> Column:
    """A token is a candidate secret if it is long and mixes cases or digits and letters; addresses always count."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.length(token) >= 20)
    return token.rlike(r"^https?://|\.(com|net)$") | token.rlike(r"^[A-Z0-9_]{16,40}$") & token.rlike("[A-Z]") | mixed


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with base and weak spans (weak ones not yet linked) and a key of the row's text."""
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*others, text.alias("__t"))
    t = F.col("__t")
    spans = {
        "assign": found(t, ASSIGN, "assign", lambda v: F.length(v) >= VALUE_LEAST, group=2),
        "access": found(t, ACCESS, "access"),
        "hex": found(t, HEX, "hex"),
        "weak": found(t, WEAK_PATTERN, weak_kind, strong_token),
    }
    rows = rows.select(*others, F.xxhash64("__t", F.length("__t")).alias("__key"), *[s.alias(f"__{k}") for k, s in spans.items()])
    return rows.withColumn("__base", F.concat(*[F.col(f"__{k}") for k in BASE]))


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts (row, start, end, kind) whose complementary parts are in reach.

    parts: row, start, end, kind, weak. Every part is dealt to the buckets that its
    scope covers; parts of one bucket are joined on their intervals, first to drop
    weak parts that overlap a base span, then to find what complements what.
    """
    bucket = F.explode(F.sequence(
        F.floor(F.greatest(F.col("start") - REACH, F.lit(0)) / REACH), F.floor((F.col("end") + REACH) / REACH)
    ))
    role = F.create_map(*[x for k, r in ROLE.items() for x in (F.lit(k), F.lit(r))])[F.col("kind")]
    dealt = parts.withColumn("role", role).withColumn("bucket", bucket)
    base = dealt.where("not weak").select("row", "bucket", F.col("start").alias("from"), F.col("end").alias("to"))
    covered = dealt.where("weak").join(base, ["row", "bucket"]).where("from < end and start < to").select("row", "start", "kind", "weak")
    dealt = dealt.join(covered.distinct(), ["row", "start", "kind", "weak"], "left_anti")
    a = dealt.where("weak").select("row", "bucket", "start", "end", "kind", "role")
    b = dealt.select("row", "bucket", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("role").alias("role_b"))
    near = a.join(b, ["row", "bucket"]).where(
        f"role <> role_b and start_b - end <= {REACH} and start - end_b <= {REACH}"
    )
    has = lambda r: F.max((F.col("role_b") == r).cast("int")) == 1
    seen = near.groupBy("row", "start", "end", "kind", "role").agg(has("identifier").alias("ids"), has("secret").alias("secrets"))
    return seen.where("(role = 'identifier' and secrets) or (role = 'secret' and ids) or (role = 'endpoint' and ids and secrets)")


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    return F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))


def scan(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) per row."""
    rows = staged(scanned(docs.select(id_col, text_col), text_col), "secrets").withColumn(
        "__row", F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col("__key").alias("key"))
    )
    # A weak part needs another part, so other rows take no part in the join.
    marked = lambda c, weak: F.transform(c, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(weak).alias("weak")))
    parts = rows.where("size(__weak) > 0 and size(__weak) + size(__base) > 1").select(
        F.col("__row").alias("row"), F.inline(F.concat(marked("__base", False), marked("__weak", True)))
    )
    links = linked(parts.distinct()).groupBy("row").agg(
        F.collect_list(F.struct(F.col("start"), F.col("end"), F.col("kind"))).alias("__more")
    )
    joined = rows.join(links.withColumnRenamed("row", "__row"), "__row", "left")
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    none = F.array().cast(SPANS)
    return joined.select(
        id_col, *[count(k) for k in BASE], F.sha2(spelled(ordered(F.col("__base"))), 256).alias("base_sha256"),
        spelled(ordered(F.concat("__base", F.coalesce("__more", none)))).alias("spans"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
