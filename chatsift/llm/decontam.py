"""Operator 5: benchmark decontamination over suffix arrays of the training texts.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII. A
window is ten words in a row of an item, or a whole item of fewer words. Each shard
of documents (some million words of whole texts, cut by Spark) gets a suffix array:
the places where a match can begin, sorted by the ten words from there on. A place
whose words aren't all benchmark words, over the shortest window, begins no match
and is left out. Every suffix of every item is looked up by binary search; the range
it finds holds all its occurrences, and occurrences in a row on one diagonal join to
the longest verbatim matches.

The benchmark is written to the shared folder in blocks of bounded size, and workers
hold one or two blocks at a time; a larger benchmark is more blocks, not a larger
broadcast. Null and empty texts have no words; rows are judged one by one, so repeated
ids are fine. Item ids are compared as strings, a null one as the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.config import scratch_path
from chatsift.llm.common import parts, read, store

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20

# A-Z to a-z; all other ASCII but digits and a-z to spaces.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

RESULT = [
    ("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"),
    ("longest_match", "long"), ("longest_item", "string"), ("longest_at", "long"),
]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


@dataclass
class Block:
    """Some benchmark items: vocabulary, distinct windows by length, and the items of each window."""

    vocab: dict[bytes, int]
    names: list[str]
    windows: dict[int, np.ndarray]  # length: (distinct windows, length)
    owners: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: starts, items, offsets

    @property
    def shortest(self) -> int:
        return min(self.windows, default=WINDOW)


def block(items: list[tuple[str, bytes | None]]) -> Block:
    vocab: dict[bytes, int] = {}
    names = sorted({n for n, _ in items})
    number = {n: i for i, n in enumerate(names)}
    found: dict[int, list] = {}
    for name, text in items:
        ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in words(text)], np.int32)
        n = min(len(ids), WINDOW)
        if n:
            view = np.lib.stride_tricks.sliding_window_view(ids, n)
            found.setdefault(n, []).append((view, np.full(len(view), number[name]), np.arange(len(view))))
    windows, owners = {}, {}
    for n, rows in found.items():
        every = np.concatenate([v for v, _, _ in rows])
        windows[n], at = np.unique(every, axis=0, return_inverse=True)
        order = np.argsort(at.reshape(-1), kind="stable")
        starts = np.searchsorted(at.reshape(-1)[order], np.arange(len(windows[n]) + 1))
        owners[n] = starts, np.concatenate([i for _, i, _ in rows])[order], np.concatenate([o for _, _, o in rows])[order]
    return Block(vocab, names, windows, owners)


@lru_cache(maxsize=2)
def load_block(path: str) -> Block:
    fs, place = store(path)
    t = pq.read_table(place, filesystem=fs)
    return block(list(zip(t["item"].to_pylist(), t["text"].to_pylist())))


def write_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> str:
    """Stage the items in files of about BLOCK_BYTES; returns the folder."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    items.repartition(1 + total // BLOCK_BYTES).write.parquet(folder)
    return folder


def block_paths(folder: str) -> list[str]:
    from pyarrow.fs import FileSelector

    fs, place = store(folder)
    prefix = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
    return sorted(prefix + f.path for f in fs.get_file_info(FileSelector(place)) if f.path.endswith(".parquet"))


def compare(suffixes: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """-1, 0, 1 per wanted row: suffixes[at] against it, over its words."""
    out = np.zeros(len(at), np.int8)
    for k in range(wanted.shape[1]):
        d = np.sign(suffixes[at, k].astype(np.int64) - wanted[:, k]).astype(np.int8)
        out = np.where(out == 0, d, out)
    return out


def search(suffixes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all wanted rows at once: the range of suffixes that begin with each."""
    bounds = []
    for after in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(suffixes), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            c = compare(suffixes, np.minimum(mid, len(suffixes) - 1), wanted)
            right = open_ & ((c <= 0) if after else (c < 0))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        bounds.append(low)
    return bounds[0], bounds[1]


def expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, place) with starts[row] <= place < ends[row]."""
    n = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def suffix_array(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, their first WINDOW words), sorted by those words; ids: 0 ends a document or is no benchmark word."""
    zero = np.flatnonzero(np.append(ids, 0) == 0)
    run = zero[np.searchsorted(zero, np.arange(len(ids)))] - np.arange(len(ids))
    places = np.flatnonzero(run >= shortest)
    if not len(places):
        return places, np.empty((0, WINDOW), ids.dtype)
    padded = np.append(ids, np.zeros(WINDOW, ids.dtype))
    rows = padded[places[:, None] + np.arange(WINDOW)]
    rows[np.arange(WINDOW) >= run[places][:, None]] = 0
    order = np.lexsort(rows.T[::-1])
    return places[order], rows[order]


def occurrences(ids: np.ndarray, b: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, window, place) of all occurrences in a shard."""
    places, rows = suffix_array(ids, b.shortest)
    for n, windows in b.windows.items():
        if len(places):
            window, at = expand(*search(rows, windows))
            yield n, window, places[at]


def longest(doc: np.ndarray, item: np.ndarray, place: np.ndarray, offset: np.ndarray, n: int, best: dict[int, tuple]) -> None:
    """Join occurrences that follow each other in document and item; keep each document's longest (ties: item, then place)."""
    diagonal = place - offset
    order = np.lexsort((place, diagonal, item, doc))
    doc, item, place, diagonal = doc[order], item[order], place[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(doc))) + n - 1
    for d, m, i, p in zip(doc[first].tolist(), length.tolist(), item[first].tolist(), place[first].tolist()):
        if d not in best or (-m, i, p) < best[d]:
            best[d] = (-m, i, p)


def judge(texts: list[bytes | None], paths: list[str]) -> dict[str, list]:
    """The result columns of a shard of whole texts."""
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    total = int((sizes + 1).sum())
    hit = np.zeros(total, bool)
    items: list[set[str]] = [set() for _ in texts]
    top: list[tuple] = [(0, None, None)] * len(texts)
    for path in paths:
        b = load_block(path)
        ids = np.zeros(total, np.int32)
        for s, w in zip(starts.tolist(), split):
            ids[s: s + len(w)] = np.fromiter(map(b.vocab.get, w, repeat(0)), np.int32, len(w))
        edge = np.zeros(total + 1, np.int32)
        best: dict[int, tuple] = {}
        for n, window, place in occurrences(ids, b):
            if not len(place):
                continue
            np.add.at(edge, place, 1)
            np.add.at(edge, place + n, -1)
            doc = np.searchsorted(starts, place, "right") - 1
            first, owner, offset = b.owners[n]
            row, k = expand(first[window], first[window + 1])
            longest(doc[row], owner[k], place[row], offset[k], n, best)
            pairs = np.unique(doc[row] * np.int64(len(b.names)) + owner[k])
            for p in pairs.tolist():
                items[p // len(b.names)].add(b.names[p % len(b.names)])
        hit |= np.cumsum(edge[:total]) > 0
        for d, (m, i, p) in best.items():
            found = (m, b.names[i], p - int(starts[d]))
            if top[d][1] is None or found < top[d]:
                top[d] = found
    n_hit = np.add.reduceat(hit, starts, dtype=np.int64) if len(texts) else np.empty(0, np.int64)
    return {
        "n_words": sizes.tolist(), "n_hit": n_hit.tolist(), "n_items": [len(s) for s in items],
        "items_sha256": [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items],
        "contaminated": [bool(n) for n in n_hit], "longest_match": [-t[0] for t in top],
        "longest_item": [t[1] for t in top], "longest_at": [t[2] for t in top],
    }


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the result columns (in place of columns of those names), one row per row."""
    new = [n for n, _ in RESULT]
    names = [c for c in docs.columns if c not in new]
    folder = write_blocks(benchmark)
    at = names.index(text_col)

    def run(batches):
        paths = block_paths(folder)
        for batch in parts(batches, at, SHARD_BYTES):
            got = judge(batch.column(at).cast(pa.binary()).to_pylist(), paths)
            types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[n], types[t]) for n, t in RESULT)], [*names, *new])

    schema = docs.select(*names).schema
    for n, t in RESULT:
        schema = schema.add(n, t)
    return docs.select(*names).mapInArrow(run, schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in benchmark windows and the items they come from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    result = contamination(docs, read(spark, sf_dir, "benchmark"))
    return result.drop("text", "longest_match", "longest_item", "longest_at")


OP5_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR),
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), lens AS (
  SELECT DISTINCT least(len(ws), 10) AS n FROM w WHERE kind = 'b' AND len(ws) > 0
), bw AS (
  SELECT DISTINCT id AS item, least(len(ws), 10) AS n, ws[i : i + least(len(ws), 10) - 1] AS win
  FROM (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM w WHERE kind = 'b' AND len(ws) > 0)
), dw AS (
  SELECT id, n, i, ws[i : i + n - 1] AS win
  FROM (SELECT id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, lens WHERE kind = 'd' AND len(ws) >= n)
), m AS (
  SELECT dw.id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, win)
), h AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1
), it AS (
  SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents JOIN w ON w.kind = 'd' AND w.id = CAST(doc_id AS VARCHAR) LEFT JOIN h ON h.id = w.id LEFT JOIN it ON it.id = w.id
"""
