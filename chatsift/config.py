"""Intents, policy windows, table schemas and session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Fixed order: decides the order of intents in responses and label vectors.
INTENTS = ["money", "alarm", "contact", "calendar", "maps"]

MESSAGE, OBSERVE = "message", "observe"
PAYMENT, DISMISSED, RESET = "payment_complete", "popup_dismissed", "reset_cooldown"


@dataclass(frozen=True)
class PolicyParams:
    """Confidence threshold and cooldown windows (seconds)."""

    threshold: float = 0.5
    cooldown: int = 300
    dismissed: int = 900
    grace: int = 60
    eviction: int = 1800


MESSAGES_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("chat_id", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("text", T.StringType()),
])

CONTROLS_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("chat_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("payer", T.StringType()),
    T.StructField("payee", T.StringType()),
    T.StructField("method", T.StringType()),
])

LABELS_TYPE = T.StructType([T.StructField(i, T.IntegerType()) for i in INTENTS])

EXAMPLES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("labels", LABELS_TYPE),
    T.StructField("category", T.StringType()),
    T.StructField("split", T.StringType()),
])

LEGACY_EXAMPLES_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, a laptop) gets a
    folder of its own; on a cluster a machine-local folder would be lost with
    the machine, so there the setting is required.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="chatsift-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
