"""Texts of a million characters that repeat what a pattern may stumble over: every operator ends, with the plain results."""

import hashlib
import time

import pytest

from chatsift.llm import decontam, fourier, jaccard, pii, quality, resampling, secrets, sentencepiece, tokenfile, toxicity

SIZE = 1_000_000
UNITS = ["a.", "a", "7", " ", "@", "a@", "1 1 ", "token=abcdef ", "token ", "a.b.c-", "[at]", "AKIA", "+1(", "0f", "\n", "x y\n", "="]
LONG = [(i, (u * SIZE)[:SIZE] + " b 1") for i, u in enumerate(UNITS)]
#: Seconds for all texts together; quadratic work takes hours.
LIMIT = 100


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(LONG, "doc_id long, text string").repartition(len(LONG)).persist()


def ended(df, start):
    rows = df.collect()
    assert time.time() - start < LIMIT
    return {r[0]: r for r in rows}


def test_secrets(texts):
    from test_texts import plain_secrets

    got = ended(secrets.scan(texts), time.time())
    for i, t in LONG:
        assert got[i].base_sha256 == hashlib.sha256(plain_secrets(t).encode()).hexdigest(), UNITS[i]


def test_personal_data(texts):
    start = time.time()
    field = pii.train(texts.withColumnRenamed("doc_id", "id"))
    got = ended(pii.find(texts, field).drop("text"), start)
    assert got[2].n_card == got[5].n_email == 0


def test_quality(texts):
    from test_texts import plain_counts

    got = ended(quality.judged(texts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), time.time())
    for i, t in LONG:
        assert tuple(got[i])[1:] == plain_counts(t), UNITS[i]


@pytest.mark.parametrize("work", ["toxicity", "decontam", "jaccard", "resampling", "fourier"])
def test_others(spark, texts, work):
    items = spark.createDataFrame([("x", "a " * 30), ("y", "b 1")], "item_id string, text string")
    start = time.time()
    df = {
        "toxicity": lambda: toxicity.score(texts, toxicity.train(
            texts.withColumnRenamed("doc_id", "id"), spark.createDataFrame([(1, 1), (2, 0)], "id long, toxic int"))).drop("text"),
        "decontam": lambda: decontam.contamination(texts, items).drop("text"),
        "jaccard": lambda: jaccard.near_duplicates(texts),
        "resampling": lambda: resampling.resample(texts, items),
        "fourier": lambda: fourier.score(texts, fourier.train(
            fourier.described(texts.withColumnRenamed("doc_id", "id")), spark.createDataFrame([(1, 1), (2, 0)], "id long, label int"))),
    }[work]()
    assert len(ended(df, start)) == len(LONG)
