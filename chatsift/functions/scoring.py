"""Intent scores: keyword rules, sigmoid and softmax over logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatsift.config import INTENTS
from chatsift.functions import vocab as V
from chatsift.functions.text import any_of


def keyword_scores(text: Column, low: Column | None = None) -> Column:
    """Five scores in intent order: high on any keyword hit, low otherwise."""
    low = F.lower(text) if low is None else low
    return F.array(*[
        F.when(any_of(low, V.INTENT_KEYWORDS[i]), V.KEYWORD_HIT).otherwise(V.KEYWORD_MISS)
        for i in INTENTS
    ])


def sigmoid(logits: Column) -> Column:
    return F.transform(logits.cast("array<double>"), lambda x: 1 / (1 + F.exp(-x)))


def softmax(logits: Column) -> Column:
    """Softmax shifted by the largest logit so that it cannot overflow."""
    x = logits.cast("array<double>")
    top = F.array_max(x)
    powers = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def label_order(id2label: dict | None, num_labels: int) -> list[str]:
    """Names of a model's outputs from its id -> label map."""
    if num_labels == 2:
        return ["not_money", "money"]
    if num_labels != len(INTENTS):
        raise ValueError(f"expected 2 or {len(INTENTS)} labels, got {num_labels}")
    known = {int(k): v for k, v in (id2label or {}).items()}
    names = [known.get(i, default) for i, default in enumerate(INTENTS)]
    unnamed = any(n.startswith("LABEL_") for n in names)
    return list(INTENTS) if unnamed else names


def intent_probs(logits: Column, order: list[str]) -> Column:
    """Map intent -> probability; intents the model does not know get 0.0."""
    probs = softmax(logits) if len(order) == 2 else sigmoid(logits)
    slots = {name: i for i, name in enumerate(order)}
    pairs = []
    for name in INTENTS:
        value = F.get(probs, F.lit(slots[name])) if name in slots else F.lit(0.0)
        pairs += [F.lit(name), value]
    return F.create_map(*pairs)
