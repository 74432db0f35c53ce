"""Who a message is aimed at: addressee, third party, self, group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatsift.functions import vocab as V
from chatsift.functions.text import any_of, rx

_NAMES_PATTERN = r"(?dU)\b(" + "|".join(V.NAMES) + r")\b"


def _listed(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for n in V.NAMES for x in (n, n)])
    return F.try_element_at(names, name)


def addressee(text: Column) -> Column:
    """A listed name after hey/yo/ok/@ (first match only), else a leading "Name,"."""
    marked = F.regexp_extract(
        F.concat(F.lit(" "), F.lower(text)), f"(?idU){V.ADDRESSEE_PATTERN}", 1
    )
    leading = F.lower(F.regexp_extract(text, f"(?dU){V.LEADING_NAME_PATTERN}", 1))
    return F.coalesce(_listed(marked), _listed(leading))


def third_party(text: Column, addressee_name: Column, sender: Column) -> Column:
    """The earliest listed name that is neither the addressee nor the sender."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_NAMES_PATTERN), F.lit(1))
    others = F.array_remove(
        F.array_remove(found, F.coalesce(addressee_name, F.lit(""))),
        F.lower(F.coalesce(sender, F.lit(""))),
    )
    return F.get(others, F.lit(0))


def is_self(text: Column, low: Column | None = None) -> Column:
    return any_of(F.lower(text) if low is None else low, V.SELF_PHRASES)


def is_mutual(text: Column) -> Column:
    return F.regexp_like(text, rx(V.MUTUAL_PATTERN, True))


def targeting(text: Column, sender: Column, low: Column | None = None, who: Column | None = None) -> Column:
    who = addressee(text) if who is None else who
    return F.struct(
        who.alias("addressee"),
        third_party(text, who, sender).alias("third_party"),
        is_self(text, low).alias("is_self"),
        is_mutual(text).alias("is_mutual"),
    )


def with_targeting(df: DataFrame, when: Column) -> DataFrame:
    """Add ``targeting`` from ``text`` and ``sender`` where it is needed.

    Unneeded rows carry a null text through the same expressions, so that no
    pattern is evaluated twice inside a conditional branch.
    """
    df = df.withColumn("_aimed", F.when(when, F.col("text")))
    low = F.col("_low") if "_low" in df.columns else None
    df = df.withColumn("_who", addressee(F.col("_aimed")))
    if low is None:
        df = df.withColumn("_low", F.lower("_aimed"))
    who = targeting(F.col("_aimed"), F.col("sender"), F.col("_low"), F.col("_who"))
    df = df.withColumn("targeting", F.when(F.col("_aimed").isNotNull(), who)).drop("_aimed", "_who")
    return df if low is not None else df.drop("_low")
