"""Registered queries against their SQL on the smallest tables."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import TABLES, compare  # noqa: E402

DIR = "/root/testdata/sf0.001"
NAMES = [
    "trigger_totals", "amounts", "phones_in_documents", "targeting", "time_phrases", "labels_and_titles",
    "payloads", "decisions", "hot_chat_decisions", "flat_replies", "frame_responses", "chat_snapshot",
    "audience", "eval_per_intent", "class_report", "filled_templates", "augmented_messages", "exact_split",
    "action_cards", "batch_scored", "stream_late_decisions", "custom_key_decisions", "popups_per_member", "stored_messages",
    "idle_sessions", "states_as_of", "live_controls", "stream_from_history", "gradient_scorer", "stored_report",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, DIR, name).startswith("ok")


def test_registry(spark):
    assert set(oracle_sql()) <= set(queries())
    # The training-data queries, where present, have tests of their own.
    own = {n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(oracle_sql()) == {"learned_scorer"}
    assert entry(spark).count() > 0
