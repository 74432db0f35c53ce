"""Operator 2: token ids in independent zstd frames with a seek table.

A file is a row of zstd frames, each with the ids (unsigned 32-bit, little-endian)
of some whole documents; a skippable frame with the document index; and, last, the
seek table of the public seekable format: compressed size, plain size and checksum
(low 32 bits of XXH64 of the plain bytes) per frame. A reader takes the footer, the
table and the index, then only the frames that hold the documents it wants.

Documents are in ascending id order over all files (null ids first; rows with one
id in no fixed order); a null or empty text has the end id alone.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatsift.config import scratch_path
from chatsift.llm.common import Bounded, new_file, partitions, parts, read, staged, store

# Fixed values of the format.
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_BYTES = 256 << 10
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


class Writer:
    """One file: frames as documents come, then index and seek table."""

    def __init__(self, path: str, level: int = 3):
        fs, place = store(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.out, self.zstd = path, fs.open_output_stream(place, compression=None), zstandard.ZstdCompressor(level=level)
        self.frame, self.plain, self.size = [], 0, 0
        self.table, self.ids, self.counts = [], [], []

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.frame.append(ids)
        self.plain += len(ids)
        if self.plain >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.frame:
            plain = b"".join(self.frame)
            data = self.zstd.compress(plain)
            self.out.write(data)
            self.table.append((len(data), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.size += len(data)
            self.frame, self.plain = [], 0

    def close(self) -> tuple[str, int, int]:
        """Path, documents, ids."""
        self.flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        counts = np.array(self.counts, "<u8")
        index = self.zstd.compress(struct.pack("<Q", len(ids)) + known.tobytes() + ids.tobytes() + counts.tobytes())
        index += struct.pack("<Q", len(index))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *t) for t in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.path, len(ids), int(counts.sum())


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, place = store(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        start = size - 9 - 12 * frames
        self.table = np.frombuffer(self.at(start, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        (length,) = struct.unpack("<Q", self.at(start - 16, 8))
        index = zstandard.ZstdDecompressor().decompress(self.at(start - 16 - length, length))
        (n,) = struct.unpack_from("<Q", index)
        known = np.frombuffer(index, np.uint8, n, 8)
        ids = np.frombuffer(index, "<i8", n, 8 + n)
        self.counts = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self.at(int(self.offsets[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]) or 1)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: checksum differs")
        return plain

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(position in the file, ids) of the documents at the positions wanted, ascending; None: all."""
        held, plain = -1, b""
        for p in range(len(self.counts)) if wanted is None else sorted(wanted):
            k = int(np.searchsorted(self.plain, 4 * self.starts[p], "right")) - 1
            if k != held:
                held, plain = k, self.frame(k)
            at = int(4 * self.starts[p] - self.plain[k])
            yield p, plain[at: at + 4 * int(self.counts[p])]


#: Bytes of Latin-1 texts that are neither ASCII (but for most control characters) nor letters.
_UNUSUAL = bytes([*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xC0), 0xD7, 0xF7])
#: A whole run of marks. One with an apostrophe may begin a piece of its own with the letters behind it.
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")
_NO_MARKS = bytes(b for b in range(256) if not 33 <= b < 127 or chr(b).isalnum())
_MARKED = bytes(33 <= b < 127 and not chr(b).isalnum() for b in range(256))
#: Words of one piece: letters, or marks.
_ONE = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
_SAMPLES = [
    "A b  c\n\td, e.f 'tis it's naïve ÀB!? 12 x|y ... (.) a.'s 's. $5.00 x_y ''' ß Über\r.", "", " ",
    "<|endoftext|> … é .\x1c µm ªb a̸",
]


class Encoder:
    """Ids of texts by the tokenizers library, with the ids of recent words kept.

    A tokenizer that drops white space and never joins what white space parts gives
    a text the ids of its words in a row. One that also lower-cases letters and keeps
    marks and letters apart gives a text of Latin letters and marks the ids of both in
    a row, and there are fewer of those. Where the vocabulary marks the ends of pieces,
    new words of one piece are encoded many at a time and cut at the ends. What holds
    for a tokenizer is found out at the start; at worst it encodes whole texts. The
    memo has a bounded size.
    """

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo = Tokenizer.from_file(path), Bounded(keep)
        # for words that are in lower case and in one piece already, all that is left to do are the merges
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        whole = self.encoded(_SAMPLES)
        for self.words in (pieces, chunks, None):
            self.memo.clear()
            if list(self.batch(_SAMPLES)) == whole:
                break

    def encoded(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def learn(self, new: list[str], together: int = 1000) -> None:
        one = list(filter(_ONE.fullmatch, new)) if self.words is pieces else []
        groups = [one[i: i + together] for i in range(0, len(one), together)]
        rest = list(set(new).difference(one)) if one else new
        for group, data in zip(groups, self.encoded([" ".join(g) for g in groups], self.merges)):
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1)).tolist()
            if len(cuts) == len(group):
                self.memo.update(zip(group, map(data.__getitem__, map(slice, [0, *cuts], cuts))))
            else:
                rest += group
        self.memo.update(zip(rest, self.encoded(rest)))

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.words:
            yield from self.encoded([t or "" for t in texts])
            return
        words = [self.words(t or "") for t in texts]
        self.memo.trim()
        rows = [list(map(self.memo.get, w)) for w in words]
        unknown = [[i for i, ids in enumerate(row) if ids is None] for row in rows]
        self.learn(list({w[i] for w, at in zip(words, unknown) for i in at}))
        for w, row, at in zip(words, rows, unknown):
            for i in at:
                row[i] = self.memo[w[i]]
            yield b"".join(row)


def chunks(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def pieces(text: str) -> list[str]:
    """Lower-case words with their marks apart, where only Latin letters, digits and marks are about; else chunks."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return chunks(text)
    if "<|" in text or len(plain.translate(None, _UNUSUAL)) < len(plain):
        return chunks(text)
    text = text.lower()
    if b"\1\1" in plain.translate(_MARKED):
        return chunks(_MARKS.sub(lambda m: m[0] if "'" in m[0] else f" {m[0]} ", text))
    for mark in map(chr, set(plain.translate(None, _NO_MARKS))):
        if mark != "'":
            text = text.replace(mark, f" {mark} ")
    return chunks(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, max_file_bytes: int = 256 << 20,
) -> DataFrame:
    """Encode and write; returns the manifest (part, number, path, documents, ids) of finished files in id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id")
    end = struct.pack("<I", end_id)

    def write(batches):
        writer, done = None, []
        for batch in parts(batches):
            ids = encoder(tokenizer).batch(batch.column(1).to_pylist())
            for doc_id, data in zip(batch.column(0).to_pylist(), ids):
                if writer is None:
                    writer = Writer(new_file(folder, "tokens", ".zst", len(done)))
                writer.add(doc_id, data + end)
                if writer.size >= max_file_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            path, documents, ids = map(list, zip(*done))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(done), pa.int32()), "number": pa.array(range(len(done)), pa.int32()),
                "path": path, "documents": documents, "ids": ids,
            })

    schema = "part int, number int, path string, documents long, ids long"
    return staged(rows.mapInArrow(write, schema), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum over files is one small row per file, of some hundred MB of text.
    """
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(before, F.lit(0))).select("path", "before")

    def scan(batches):
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns)):
                r = Reader(path)
                crc = [zlib.crc32(ids) for _, ids in r.documents()]
                for at in range(0, len(crc), 65536):
                    to = slice(at, at + 65536)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(r.doc_ids[to], pa.int64()),
                        "start": pa.array(before + r.starts[:-1][to], pa.int64()),
                        "n_tokens": pa.array(r.counts[to], pa.int64()), "ids_crc32": pa.array(crc[to], pa.int64()),
                    })

    return files.repartition(partitions(manifest.sparkSession)).mapInArrow(
        scan, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in files, read back from them."""
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return read_tokens(manifest)
