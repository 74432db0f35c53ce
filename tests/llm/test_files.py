"""WARC archives, token files, SentencePiece coding and sharding against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatsift.config import scratch_path
from chatsift.llm import sentencepiece, sharding, tokenfile, warc

tokenizers = pytest.importorskip("public_tokenizers")


def pages_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_warc_round_trip_and_revisits(spark):
    long = "é<p>" * 60
    rows = [(3, "http://a/é x", long, "clash"), (1, None, long, None), (2, "u\r\nInjected: 1", "short", None), (4, "u", "short", None),
            (5, "u", None, None), (6, "u", "", None), (None, "u", long, None), (1, None, long, None), (7, "u", "x" * 3_000_000, None)]
    manifest = warc.write_archives(pages_table(spark, rows), scratch_path(spark, "warc"), max_file_bytes=500)
    found = warc.resolved(warc.read_archives(manifest)).collect()
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    want = []
    for uid, _, html, _ in rows:
        payload = (html or "").encode()
        revisit = uid == 3
        want.append((-1 if uid is None else uid, len(payload), hashlib.sha256(payload).hexdigest(),
                     "revisit" if revisit else "response", 1 if revisit else None))
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    texts = {}
    for r in manifest.collect():
        for head, payload, _, _ in warc.read_archive(r.path):
            if head["warc-type"] == "response":
                texts.setdefault(head["warc-record-id"], payload)
            assert "injected" not in head
    assert texts["<urn:page:7>"] == b"x" * 3_000_000


def test_warc_finds_damage(spark, tmp_path):
    folder = scratch_path(spark, "warc")
    path = warc.write_archives(pages_table(spark, [(1, "u", "text " * 50, None)]), folder).first().path
    data = open(path.removeprefix("file:"), "rb").read()
    plain = zlib.decompress(data, 31)
    for damaged in (data[:-20], zlib_member(plain.replace(b"text text", b"test text", 1))):
        bad = tmp_path / "bad.warc.gz"
        bad.write_bytes(damaged)
        with pytest.raises(ValueError):
            list(warc.read_archive(str(bad)))


def zlib_member(plain):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


def test_warc_empty_table(spark):
    manifest = warc.write_archives(pages_table(spark, []), scratch_path(spark, "warc"))
    assert warc.resolved(warc.read_archives(manifest)).collect() == []


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Thé", "the.", "ΣΑΣ", "x1y22", "it's", "a\x1cb", "ñ,", "<|endoftext|>", "12"]) for _ in range(n))


def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path(tokenfile.TOKENIZER)
    rows = [(i * 7 % 101, words(i * 13 % 90, i), "x") for i in range(101)] + [(200, None, "x"), (201, "", "x"), (202, words(60_000), "x"), (5, words(5), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    manifest = tokenfile.write_tokens(docs, scratch_path(spark, "tokens"), path, max_file_bytes=4000)
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    want, start = {}, 0
    for uid, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault(uid, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens


def test_encoder_by_word_or_whole():
    from tokenizers import Tokenizer

    odd = ["\u0130stanbul \u00c7A, \u00df. \u00b5m \u00aab a\u0338 Thin, Thin! thin", "'s 'T isn't WE'RE", " a b\x0bc\x1cd ", "a|b ||| .,. \u00c0\u00c0!", None, ""]
    marks = "".join(map(chr, range(33, 127))) + "aA\u00e9\u00c9 \n''..  <|"
    odd += ["".join(random.Random(i).choices(marks, k=300)) for i in range(60)] + ["".join(map(chr, range(1, 256)))]
    for name, by in ((tokenfile.TOKENIZER, tokenfile.pieces), ("byte_bpe_50k.json", None)):
        path = tokenizers.path(name)
        e, t = tokenfile.Encoder(path, keep=40), Tokenizer.from_file(path)
        assert e.words == by
        for i in range(30):
            texts = [words(40, i), *odd]
            want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
            assert list(e.batch(texts)) == want


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = tokenfile.write_tokens(docs, scratch_path(spark, "tokens"), tokenizers.path(tokenfile.TOKENIZER))
    assert tokenfile.read_tokens(manifest).count() == 0


def test_reader_takes_single_documents_and_checks_frames(tmp_path):
    w = tokenfile.Writer(str(tmp_path / "t.zst"))
    texts = [np.arange(i * 997 % 40_000, dtype="<u4").tobytes() for i in range(40)]
    for i, ids in enumerate(texts):
        w.add(i if i else None, ids)
    path, n, _ = w.close()
    r = tokenfile.Reader(path)
    assert n == 40 and r.doc_ids[0] is None and len(r.table) > 3
    read = []
    whole, r.frame = r.frame, lambda k: read.append(k) or whole(k)
    assert list(r.documents([7, 30])) == [(7, texts[7]), (30, texts[30])] and len(read) <= 2
    assert [ids for _, ids in r.documents()] == texts
    data = bytearray(open(path, "rb").read())
    k = len(r.table) - 1
    r.table = r.table.copy()
    r.table[k, 2] ^= 1
    with pytest.raises(ValueError):
        whole(k)
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")


def plain_viterbi(pieces, text, cost):
    best = [(0.0, [])] + [None] * len(text)
    for i in range(len(text)):
        if best[i] is None:
            continue
        for n in range(1, len(text) - i + 1):
            s = pieces.get(text[i: i + n], cost if n == 1 else None)
            if s is not None and (best[i + n] is None or best[i][0] + s > best[i + n][0]):
                best[i + n] = best[i][0] + s, best[i][1] + [text[i: i + n]]
    return best[-1][0]


def test_a_piece_of_line_ends_forbids_cuts_at_them():
    plain = [("<unk>", 0.0, sentencepiece.UNKNOWN), ("a", -1.0, sentencepiece.NORMAL)]
    assert sentencepiece.Model([*plain, ("\n", -2.0, sentencepiece.NORMAL)]).safe
    for p in ("\n\n", "a\n", "\na"):
        assert not sentencepiece.Model([*plain, (p, -2.0, sentencepiece.NORMAL)]).safe


def test_sentencepiece_takes_the_best_segmentation(spark):
    model = sentencepiece.Model.load(tokenizers.path(sentencepiece.MODEL))
    import sentencepiece as sp

    lib = sp.SentencePieceProcessor(model_file=tokenizers.path(sentencepiece.MODEL))
    pieces = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    rng, memo = random.Random(3), sentencepiece.Memo(model)
    for _ in range(150):
        text = "".join(rng.choice("the naive  é\n梦🙂ß0.x") for _ in range(rng.randrange(1, 24)))
        ids = np.frombuffer(model.encode(text, memo), "<u4").tolist()
        score, run = 0.0, b""
        for i in ids + [None]:
            if i is not None and lib.is_byte(i):
                run += bytes([int(lib.id_to_piece(i)[3:5], 16)])
                continue
            score += model.cost * len(run.decode())
            run = b""
            score += lib.get_score(i) if i is not None else 0
        assert score == pytest.approx(plain_viterbi(pieces, "▁" + text.replace(" ", "▁"), model.cost))
        assert model.decode(model.encode(text, memo)) == text
    assert model.encode(None, memo) == model.encode("", memo) == b""


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(4)
    keys = {bytes(rng.choices(b"abc\xff\x00", k=rng.randrange(1, 6))): i for i in range(400)}
    trie = sentencepiece.DoubleArray(keys)
    for _ in range(300):
        text = bytes(rng.choices(b"abc\xff\x00d", k=8))
        assert list(trie.prefixes(text, 0)) == [(n, keys[text[:n]]) for n in range(1, 9) if text[:n] in keys]


def test_sentencepiece_rows(spark):
    docs = spark.createDataFrame([(1, "a b\n c  d ", 5), (2, None, 6), (3, "", None), (4, "w" * 100_000, 1)], "doc_id long, text string, n_tokens long")
    rows = {r.doc_id: r for r in sentencepiece.encode(docs.drop("n_tokens"), sentencepiece.shared_model(spark)).collect()}
    assert all(r.round_trip for r in rows.values()) and rows[2].n_tokens == rows[3].n_tokens == 0
    assert sentencepiece.encode(docs.drop("n_tokens").limit(0), sentencepiece.shared_model(spark)).count() == 0


def test_shards_take_turns():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer)) / 1009
    assert 1 / 7 <= moved < 0.4  # all of the lost shard's slots, few others
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    with pytest.raises(ValueError):
        sharding.lookup_table([])


def test_sharding_rows(spark):
    rows = [(i, "x") for i in range(50)] + [(None, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, slot string")
    table = sharding.lookup_table(sharding.SHARDS)
    got = sharding.place(df, "doc_id").collect()
    assert len(got) == 52
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(df.limit(0), "doc_id").count() == 0


def test_shards_hold_whole_rows(spark):
    rows = [(i, f"text {i}" * (i % 9), 0.5, "old") for i in range(90)] + [(7, "copy", None, "old")] * 400 + [(None, None, 1.0, None), (91, "x" * 300_000, 2.0, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, shard string").repartition(3)
    back = sharding.write_shards(df, "doc_id", scratch_path(spark, "shards"), shards=["a", "b", "c"], slots=101, file_bytes=20_000)
    got = back.withColumn("file", F.input_file_name()).collect()
    assert back.columns == ["doc_id", "text", "score", "slot", "shard"]
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(repr(r[:3]) for r in rows)
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert all(r.shard == "abc"[table[r.slot]] and f"shard={r.shard}/" in r.file for r in got)
    assert len({r.file for r in got if r.doc_id == 7}) > 2  # copies are spread
    none = sharding.write_shards(df.limit(0), "doc_id", scratch_path(spark, "shards"))
    assert none.count() == 0
