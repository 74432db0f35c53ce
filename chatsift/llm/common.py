"""Shared by the operators: staged tables, files on the shared store, text batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from chatsift.config import scratch_path

#: Text handed to one step of a worker at once, whatever the batch holds.
SLICE_BYTES = 2 << 20


#: Rows of a batch between the JVM and a worker: texts can be long, and memory is shared by several workers.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows reads files that every executor sees, so a lost executor costs
    no earlier stage, and rows with generated numbers keep them. Shuffle files
    of the work before are of no more use: the driver's collector is asked to
    let Spark remove them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables. Only for tables that nothing reads any more, not even to repeat a lost task: all that came from them is staged."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(path)


def new_file(folder: str, kind: str, suffix: str, number: int) -> str:
    """A name no other attempt of the task uses: only files listed in a staged manifest count."""
    t = TaskContext.get()
    return f"{folder}/{kind}-{t.partitionId():06d}-{t.taskAttemptId():08d}-{number:04d}{suffix}"


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part stay near ``limit`` bytes; a longer text comes alone."""
    sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def parts(batches: Iterable[pa.RecordBatch], text: int = -1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, text % batch.num_columns, limit)


class Bounded(dict):
    """A memo that empties itself before it outgrows ``limit`` entries."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


#: SQL of a table ``crc`` with one list ``t``: the 256 steps of CRC-32.
CRC_TABLE_SQL = """
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)"""


def crc32_sql(h: str) -> str:
    """SQL of the unsigned CRC-32 of bytes given as hex digits, beside a row of ``crc``."""
    return f"""xor(list_reduce(
    list_transform(range(0, length({h}) // 2), lambda k: cast('0x' || substr({h}, 2 * k + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"""
