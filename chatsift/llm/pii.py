"""Operator 8: personal data by patterns and a skip-chain conditional random field.

Base spans are matches of four patterns (email, ip, card, phone), checked and dropped
where the check fails. Mentions are the base spans and, beside them, everything else
that looks like an address or a number. The field's variables are the mentions'
labels (none or one of the kinds). Node potentials come from a mention's surroundings
and size, and not from what the base patterns ask for, so that a number without its plus sign
can look like one with it. Chain potentials join neighbours, skip potentials mentions with the same
address or the same digits, however far apart. All three are learned together, by
gradient steps on the pseudo-likelihood of the base labels; mentions that share a key
with a base span but are none have no known label and count for nothing there.

Loopy sum-product messages make the labels of a document agree. A mention without a
base span becomes a span if its likeliest label is a kind and either its belief is SURE
or links through mentions of that kind lead to a base span of it. Equal beliefs go to
the kind listed first. Base spans stay as they are.

Potentials are learned on a bounded sample of documents (``max_docs`` ids, the smallest
by hash, of those with a digit or an @; ``max_mentions`` of each). Mentions that share
a key are linked in a row, first to next, so links grow with the mentions and not with
their square. Null and empty texts have no spans; rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatsift.llm.common import parts, read

KINDS = ["email", "ip", "card", "phone"]
NONE = len(KINDS)

# The base patterns, written so that each runs in linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_MAYBE = re.compile(r"[0-9@]|\[at\]")
_ANCHOR = re.compile(r"@|\[at\]")
_SIDE = re.compile(r"[^\s@<>(),;:\"]+")
_BOUND = frozenset("@<>(),;:\"")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])+")

SLOTS = 1 << 13
ROUNDS = 12
SURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @ and the longest domain after it."""
    out, free = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    if not text or not _MAYBE.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind or NONE, end) of base spans and of what else may be one, not overlapping them."""
    out, free = [], 0
    for s, k, e in base:
        if s >= free:  # of overlapping base spans the first stands for both
            out.append((s, k, e))
            free = e
    for find in (addresses, numbers):
        gaps = zip([0, *(e for _, _, e in out)], [*(s for s, _, _ in out), len(text)])
        out = sorted(out + [(s, NONE, e) for a, b in gaps for s, e in find(text, a, b) if e - s >= 6])
    return out


def addresses(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """What looks like an address: an @ or [at] with a run of other characters on both sides, a space between at most."""
    out, free = [], a
    for m in _ANCHOR.finditer(text, a, b):
        if m.start() < free:
            continue
        end = m.start() - (m.start() > free and text[m.start() - 1] == " ")
        start = end
        while start > free and text[start - 1] not in _BOUND and not text[start - 1].isspace():
            start -= 1
        side = _SIDE.match(text, m.end() + (text[m.end(): m.end() + 1] == " "), b)
        if start < end and side:
            out.append((start, side.end()))
            free = side.end()
    return out


def numbers(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _NUMBER.finditer(text, a, b)]


def clues(text: str, start: int, end: int) -> list[int]:
    """Feature slots of a mention: what stands around it, and its size."""
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    before = text[max(0, start - 32): start].lower().split()[-2:]
    after = text[end: end + 24].lower().split()[:1]
    kind = "address" if "@" in s or "[at]" in s else "number"
    names = [
        "", kind, f"{kind}:{next((n for n in (6, 9, 11, 15, 19) if digits <= n), 20)}", f"dots:{kind}:{min(s.count('.'), 4)}",
        f"gaps:{kind}:{min(s.count(' ') + s.count('-'), 1)}",
        f"before:{kind}:" + (before[-1][-12:] if before else "-"), f"earlier:{kind}:" + (before[-2][-12:] if len(before) > 1 else "-"),
        f"after:{kind}:" + (after[0][:12] if after else "-"),
    ]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


def keys(s: str) -> list[str]:
    """What a mention shares with others of the same entity."""
    if "@" in s or "[at]" in s:
        return ["@" + re.sub(r"\s|\[at\]", "@", s.lower().rstrip(".")).replace("@@", "@").replace("@@", "@")]
    digits = re.sub(r"[^0-9]", "", s)
    dots = ["." + s] if s.count(".") == 3 else []
    return dots + [f"{n}:{digits[-n:]}" for n in (16, 10, 7) if len(digits) >= n][:2]


def edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links of neighbours within 80 characters; skip links between mentions with a key in common."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][2] <= 80]
    last: dict[str, int] = {}
    skip = set()
    for i, (s, _, e) in enumerate(found):
        for k in keys(text[s:e]):
            if k in last:
                skip.add((last[k], i))
            last[k] = i
    return chain, sorted(skip)


class Field:
    """Learned potentials: weights of clues, chain and skip tables over labels."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def beliefs(self, nodes: list[list[int]], base: list[int], chain: list, skip: list) -> np.ndarray:
        """Label probabilities by loopy message passing; base labels are held."""
        theta = self.weights[np.array(nodes)].sum(1)
        base_ = np.array(base)
        held = np.flatnonzero(base_ < NONE)
        theta[held] = -30.0
        theta[held, base_[held]] = 0.0
        ends = np.array(chain + skip, np.int64).reshape(-1, 2)
        if not len(ends):
            return softmax(theta)
        tables = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        message = np.zeros((len(source), NONE + 1))
        for _ in range(ROUNDS):
            total = theta.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + tables
            top = out.max(1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(1, keepdims=True)))[:, 0]
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        np.add.at(theta, target, message)
        return softmax(theta)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def agreement(same: float = 0.99) -> np.ndarray:
    """Skip potentials before any link is seen: mentions with a key in common mean one entity."""
    table = np.full((NONE + 1, NONE + 1), np.log((1 - same) / NONE))
    np.fill_diagonal(table, np.log(same))
    return table


def counted(y: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Labels of linked mentions (there) per mention (here)."""
    out = np.zeros((len(y), NONE + 1))
    np.add.at(out, (here, y[there]), 1)
    return out


def fit(rows: list[tuple[list[list[int]], list[int], list, list]], steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Documents as (clues, labels, chain, skip): all potentials by Adam on the pseudo-likelihood, each label given its neighbours'."""
    weights, tables = np.zeros((SLOTS, NONE + 1)), [np.zeros((NONE + 1, NONE + 1)), agreement()]
    y = np.array([k for r in rows for k in r[1]], np.int64)
    if not len(y):
        return Field(weights, *tables)
    used, x = np.unique(np.array([c for r in rows for c in r[0]], np.int64), return_inverse=True)
    x = x.reshape(len(y), -1)
    at = np.cumsum([0] + [len(r[1]) for r in rows])
    chain, skip = (np.array([(i + o, j + o) for r, o in zip(rows, at) for i, j in r[k]], np.int64).reshape(-1, 2) for k in (2, 3))
    left, right = counted(y, chain[:, 1], chain[:, 0]), counted(y, chain[:, 0], chain[:, 1])
    linked = counted(y, skip[:, 0], skip[:, 1]) + counted(y, skip[:, 1], skip[:, 0])
    known = ((y < NONE) | (linked[:, :NONE].sum(1) == 0)).astype(float)[:, None]
    want, total = np.eye(NONE + 1)[y], max(known.sum(), 1)
    values = [np.zeros((len(used), NONE + 1)), *tables]
    start = [v.copy() for v in values]
    m, v = [0.0] * 3, [0.0] * 3
    for step in range(1, steps + 1):
        w, c, s = values
        d = known * (softmax(w[x].sum(1) + left @ c + right @ c.T + linked @ s) - want) / total
        slopes = [
            np.stack([np.bincount(x.ravel(), np.repeat(d[:, k], x.shape[1]), len(used)) for k in range(NONE + 1)], 1),
            left.T @ d + d.T @ right, (linked.T @ d + d.T @ linked) / 2,
        ]
        for i, (g, back) in enumerate(zip(slopes, (decay, 1e-3, 1e-3))):
            g = g + back * (values[i] - start[i])
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            values[i] = values[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    weights[used] = values[0]
    return Field(weights, values[1], values[2])


def sampled(text: str, most: int) -> tuple[list[int], list[int], list[int], list[int]] | None:
    """Clues, labels, chain and skip links of a text's mentions; of more than ``most`` those with the smallest hash."""
    found = mentions(text, base_spans(text))
    if len(found) > most:
        found = sorted(sorted(found, key=lambda f: (zlib.crc32(f"{f[0]}:{text[f[0]: f[2]]}".encode()), f))[:most])
    if not found:
        return None
    chain, skip = edges(text, found)
    return ([i for s, _, e in found for i in clues(text, s, e)], [k for _, k, _ in found],
            [i for p in chain for i in p], [i for p in skip for i in p])


def train(docs: DataFrame, *, max_docs: int = 20_000, max_mentions: int = 1000) -> Field:
    """Fit on docs (id, text): the sample's mentions come to the driver as slots and links.

    The sample: one text (the smallest by hash) of each of ``max_docs`` ids, the smallest
    by hash of those with a digit or an @, and ``max_mentions`` mentions of each.
    """
    ids = (
        docs.where("id is not null").where(F.col("text").rlike("[0-9@]")).select("id").distinct()
        .orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(max_docs)
    )
    rows = docs.join(F.broadcast(ids), "id").select("id", F.xxhash64("text").alias("h"), "text")
    schema = rows.select("id", "h").schema
    lists = ("clues", "labels", "chain", "skip")
    for name in lists:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))

    def extract(batches):
        for batch in parts(batches):
            told = [sampled(t or "", max_mentions) for t in batch.column(2).to_pylist()]
            at = [i for i, x in enumerate(told) if x]
            if at:
                kept = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns[:2], *(pa.array(c, pa.list_(pa.int32())) for c in zip(*(told[i] for i in at)))], schema.names)

    found = rows.mapInArrow(extract, schema).groupBy("id").agg(F.min_by(F.struct(*lists), "h").alias("r")).select("r.*").collect()
    pair = lambda a: list(zip(a[::2], a[1::2]))
    return fit([
        ([r.clues[i: i + len(r.clues) // len(r.labels)] for i in range(0, len(r.clues), len(r.clues) // len(r.labels))],
         list(r.labels), pair(r.chain), pair(r.skip)) for r in found
    ])


def spans(text: str | None, field: Field) -> tuple[list, list]:
    """Base spans, and base and added spans, as (start, kind, end) in order."""
    base = base_spans(text)
    if not text or not _MAYBE.search(text):
        return base, base
    found = mentions(text, base)
    if all(k < NONE for _, k, _ in found):
        return base, base
    chain, skip = edges(text, found)
    near: dict[int, list[int]] = defaultdict(list)
    for i, j in skip:
        near[i].append(j)
        near[j].append(i)
    p = field.beliefs([clues(text, s, e) for s, _, e in found], [k for _, k, _ in found], chain, skip)
    label = p.argmax(1)
    added = []
    for i, (s, k, e) in enumerate(found):
        if k == NONE and label[i] < NONE and (p[i, label[i]] >= SURE or reaches(i, int(label[i]), near, found, label)):
            added.append((s, int(label[i]), e))
    return base, sorted(base + added)


def reaches(i: int, kind: int, near: dict[int, list[int]], found: list, label) -> bool:
    """A base span of the kind is linked with mention i, through mentions of that kind."""
    seen, todo = {i}, [i]
    while todo:
        for j in near[todo.pop()]:
            if found[j][1] == kind:
                return True
            if j not in seen and found[j][1] == NONE and label[j] == kind:
                seen.add(j)
                todo.append(j)
    return False


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with spans replaced by [KIND]; overlapping ones by the first one's."""
    if not found:
        return text
    out, free = [], 0
    for s, k, e in found:
        if s >= free:
            out += [text[free:s], f"[{KINDS[k].upper()}]"]
        free = max(free, e)
    return "".join(out) + text[free:]


RESULT = [(f"n_{k}", "long") for k in KINDS] + [("base_sha256", "string"), ("spans", "string")]


def find(docs: DataFrame, field: Field, *, text_col: str = "text", redact: bool = False) -> DataFrame:
    """docs with counts, base_sha256 and spans (in place of columns of those names); ``redact`` masks the text."""
    new = [n for n, _ in RESULT]
    names = [c for c in docs.columns if c not in new]
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # SLOTS rows, whatever the input

    def run(batches):
        f = shared.value
        for batch in parts(batches, at):
            rows, texts = [], []
            for text in batch.column(at).to_pylist():
                base, every = spans(text, f)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(NONE)), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
                texts.append(redacted(text, every) if redact else text)
            cols = list(batch.columns)
            if redact:
                cols[at] = pa.array(texts, pa.string())
            types = [pa.int64()] * NONE + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [*names, *new])

    schema = docs.select(*names).schema
    for n, t in RESULT:
        schema = schema.add(n, t)
    return docs.select(*names).mapInArrow(run, schema)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return find(docs, train(docs.withColumnRenamed("doc_id", "id"))).drop("text")
