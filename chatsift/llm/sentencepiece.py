"""Operator 4: SentencePiece encoding and decoding.

Unigram segmentation: the pieces of the model sit in a double-array trie over their
UTF-8 bytes, and Viterbi takes the segmentation with the largest sum of scores; of
equal sums the one found first wins, from left to right and short pieces first. A
character that no piece covers costs the lowest score less ten and becomes its bytes'
pieces (or the unknown piece, in a model without them). White space is written as a
marker, with one before the text; decoding turns markers into spaces and drops the
first. Null and empty texts have no ids. A text is cut only where no piece of the
model can cross, so the ids are those of the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsift.llm.common import Bounded, parts, read

# Fixed values of the model format and of unigram models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0

MODEL = "piece_bpe_32k.model"


class DoubleArray:
    """Trie over byte strings in two arrays: child = base[node] + byte + 1, valid if check[child] == node."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for b in key:
                if b not in tree[node]:
                    tree[node][b] = len(tree)
                    tree.append({})
                node = tree[node][b]
            ends[node] = value
        size = 4 * len(tree) + 4096
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = np.zeros(size, bool)
        used[:257] = True  # so that no base is negative
        free = low = 257
        window = 1024
        queue = [(0, 0)]
        for node, place in queue:
            value[place] = ends.get(node, -1)
            children = sorted(tree[node])
            if not children:
                continue
            if len(children) == 1:
                while used[free]:
                    free += 1
                at = free
            else:
                at = max(low, free)
                while True:  # the first place of a window that has room for all children
                    taken = used[at: at + window].copy()
                    for b in children[1:]:
                        o = at + b - children[0]
                        taken |= used[o: o + window]
                    room = int(taken.argmin())
                    if not taken[room]:
                        at += room
                        break
                    at += window
                    low = at
            base[place] = at - children[0] - 1
            for b in children:
                child = base[place] + b + 1
                used[child] = True
                check[child] = place
                queue.append((tree[node][b], child))
        top = int(np.flatnonzero(used)[-1]) + 300
        self.base, self.check, self.value = (a[:top] + [f] * (top - len(a)) for a, f in ((base, 0), (check, -1), (value, -1)))

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of the keys that begin at a place, short ones first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for i in range(at, len(text)):
            child = base[node] + text[i] + 1
            if check[child] != node:
                return
            node = child
            if value[node] >= 0:
                yield i + 1, value[node]


class Model:
    """Pieces, scores and trie; built once and sent to the workers, its size that of the vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool = True):
        self.scores = [s for _, s, _ in pieces]
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER, UNUSED)}
        self.trie = DoubleArray({p.encode(): i for p, i in normal.items() if pieces[i][2] != UNUSED})
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.cost = min([s for (_, s, k) in pieces if k in (NORMAL, USER)], default=0.0) - UNKNOWN_COST
        back = {i: bytes([b]) for b, i in self.bytes.items()}
        self.plain = [
            back[i] if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, _, k) in enumerate(pieces)
        ]
        self.prefix = prefix
        # Where no piece crosses: before a run of markers, and around line ends, unless a piece says otherwise.
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        lines = any("\n" in p and p != "\n" for p in normal)
        self.cut = re.compile(r" *[^ ]+| +")
        self.safe = not (inner or lines)

    @classmethod
    def load(cls, path: str) -> Model:
        """Read a model file with the library; only its pieces are used."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: (UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i)
                          else UNUSED if sp.is_unused(i) else NORMAL)
        return cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of a piece of text whose spaces are markers."""
        text = chunk.encode()
        n = len(text)
        best, come, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        at = 0
        while at < n:
            lead = text[at]
            step = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, node, single = best[at], 0, False
            for i in range(at, n):
                child = base[node] + text[i] + 1
                if check[child] != node:
                    break
                node = child
                v = value[node]
                if v >= 0:
                    s = here + scores[v]
                    if best[i + 1] is None or s > best[i + 1]:
                        best[i + 1], come[i + 1], piece[i + 1] = s, at, v
                    single = single or i + 1 == step
            if not single:
                s = here + self.cost
                if best[step] is None or s > best[step]:
                    best[step], come[step], piece[step] = s, at, -1
            at = step
        out: list[list[int]] = []
        while n:
            at = come[n]
            if piece[n] >= 0:
                out.append([piece[n]])
            elif self.bytes:
                out.append([self.bytes[b] for b in text[at:n]])
            else:
                out.append([self.unknown])
            n = at
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str | None, memo: Memo) -> bytes:
        """Ids as unsigned 32-bit little-endian."""
        if not text:
            return b""
        if not self.safe:
            return memo.whole[" " + text if self.prefix else text]
        out: list[bytes] = []
        spaced, whole = memo.spaced.__getitem__, memo.whole.__getitem__
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(whole("\n"))
            elif self.prefix:
                line = " " + line
            if "  " in line or line.endswith(" "):
                out += map(whole, self.cut.findall(line))
            else:  # the same pieces, cut faster
                words = line.split(" ")
                if words[0]:
                    out.append(whole(words[0]))
                out += map(spaced, words[1:])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Memo:
    """Ids of recent pieces of text, and of recent words with a space before them; bounded."""

    class Part(Bounded):
        def __init__(self, model: Model, before: str, limit: int):
            super().__init__(limit)
            self.model, self.before = model, before

        def __missing__(self, word: str) -> bytes:
            self[word] = ids = np.array(self.model.viterbi((self.before + word).replace(" ", MARK)), "<u4").tobytes()
            return ids

    def __init__(self, model: Model, limit: int = 600_000):
        self.spaced, self.whole = self.Part(model, " ", limit), self.Part(model, "", limit // 4)

    def trim(self) -> None:
        self.spaced.trim()
        self.whole.trim()


def encode(docs: DataFrame, model: Broadcast, *, text_col: str = "text", ids: bool = True, decode: bool = True) -> DataFrame:
    """docs without the text, with n_tokens, ids_crc32, round_trip (decoding gives the text back) and, if asked for, ids."""
    names = [c for c in docs.columns if c != text_col]
    new = [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())] + ([("ids", pa.binary())] if ids else [])

    def run(batches):
        m = model.value
        memo = Memo(m)
        for batch in parts(batches):
            memo.trim()
            texts = batch.column(len(names)).to_pylist()
            coded = [m.encode(t, memo) for t in texts]
            cols = [[len(c) // 4 for c in coded], [zlib.crc32(c) for c in coded],
                    [m.decode(c) == (t or "") for c, t in zip(coded, texts)] if decode else [None] * len(coded), coded]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *(pa.array(c, t) for c, (_, t) in zip(cols, new))], [*names, *(n for n, _ in new)]
            )

    schema = docs.select(*names).schema
    for n, t in new:
        schema = schema.add(n, {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}[t])
    return docs.select(*names, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def shared_model(spark: SparkSession) -> Broadcast:
    import public_tokenizers

    return spark.sparkContext.broadcast(Model.load(public_tokenizers.path(MODEL)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, shared_model(spark), ids=False)
