"""Operator 7: sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: an offset
and a step from its name's hash. The shards take turns, each claiming its first free
slot, until the table is full; so shares differ by one slot at most, and a change of
one shard moves few keys. A key's slot is its hash modulo the size; the table has a
fixed size and is broadcast, so a row finds its shard in constant time.

Shards are written with all columns, one folder each. A shard has as many files as its
bytes call for, and a row's file follows from its place in the input, not from its
content: copies of a row, and the rows of a hot key, spread over all files of their
shard. Null keys share the slot of the empty string; an empty table has no folders.
Columns of the names slot and shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.config import scratch_path
from chatsift.llm.common import partitions, read

SLOTS = 65_537  # prime
FILE_BYTES = 256 << 20
SHARDS = [f"shard-{i:03d}" for i in range(96)]


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number per slot."""
    if not shards or len(set(shards)) != len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs distinct shard names and a prime table size")
    at = [digest("offset:" + s) % slots for s in shards]
    step = [digest("step:" + s) % (slots - 1) + 1 for s in shards]
    table = [-1] * slots
    filled = 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            filled += 1
            if filled == slots:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    hashed = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with ``slot`` and ``shard`` (in place of columns of those names)."""
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot int, shard string"
    )
    rows = rows.drop("slot", "shard").withColumn("slot", slot(F.col(key), slots))
    return rows.join(F.broadcast(table), "slot", "left").select(*rows.columns, "shard")


def size(rows: DataFrame) -> int:
    """Bytes of all rows: of texts and binaries their length, of all else eight per column."""
    each = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in rows.dtypes]
    return rows.agg(F.sum(sum(each[1:], each[0]).cast("long")).alias("n")).first().n or 0


def write_shards(
    rows: DataFrame, key: str, path: str, shards: list[str] = SHARDS, slots: int = SLOTS, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write rows to a folder per shard, in files of about ``file_bytes``; returns them as read back, with slot and shard."""
    files = max(1, -(-size(rows) // (len(shards) * file_bytes)))
    placed = place(rows, key, shards, slots).withColumn("__file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)))
    tasks = max(partitions(rows.sparkSession), len(shards) * files)  # a number of its own, else Spark would join small ones
    placed.repartition(tasks, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(placed.drop("__file").schema).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, read from the shards, with the size of its text there."""
    shards = write_shards(read(spark, sf_dir, "documents"), "doc_id", scratch_path(spark, "shards"))
    return shards.select("doc_id", "source", "n_chars", "slot", "shard", F.length("text").alias("text_chars"))
