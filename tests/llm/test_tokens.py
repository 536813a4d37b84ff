"""Token counts, byte-level BPE and TIFF pages against other libraries, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from vellumine.llm import bpe, queries, tiff, unigram

SMALL = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é中\U0001f600 \n\n  x"), (5, "word " * 30_000), (6, "a" * 5000), (7, " \t\r\n "), (8, "it's we'll 12 345 x y")]


def texts(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abeiou thx中文\U0001f600é\n\t  1290'!.") for _ in range(draw.randint(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    with open(VOCAB, "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_merges(spark, ranks, reference):
    coder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.StreamDecoder({r: t for t, r in ranks.items()})
    docs = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for text in [*docs, *texts(800, 1), *(t or "" for _, t in EDGES)]:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert decoder.decode(ids) == text
    plain = bpe.Encoder(ranks, r"\S+|\s+")
    other = tiktoken.Encoding("other", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    assert all(plain.encode(t) == other.encode_ordinary(t) for t in texts(200, 2))


def test_bpe_keeps_its_results_when_its_memory_is_cleared(ranks, reference, monkeypatch):
    for name, value in (("MEMO_STATES", 50), ("MEMO_PAIRS", 20), ("MEMO_PIECES", 7), ("MEMO_BYTES", 6)):
        monkeypatch.setattr(bpe, name, value)
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert all(coder.encode(t) == reference.encode_ordinary(t) for t in [*texts(300, 3), "abab" * 900, "é" * 900])


def test_stream_decoding_replaces_as_bytes_would(ranks):
    data = {r: t for t, r in ranks.items()}
    decoder, draw = bpe.StreamDecoder(data), random.Random(4)
    for _ in range(4000):
        ids = [draw.randrange(256) if draw.random() < 0.7 else draw.randrange(50_000) for _ in range(6)]
        assert decoder.decode(ids) == b"".join(data[i] for i in ids).decode("utf-8", "replace")


def test_bpe_query(spark, reference):
    docs = spark.createDataFrame([(i, t, "c") for i, t in EDGES], "doc_id long, text string, ids string")
    got = bpe.digests(docs, vocab_path=VOCAB, pattern=public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in EDGES:
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe.digests(docs.limit(0), vocab_path=VOCAB, pattern=public_tokenizers.PATTERN).count() == 0


def test_bpe_cuts_at_white_space_of_all_kinds(ranks, reference):
    coder, draw = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(6)
    some = ["".join(draw.choice("ab.'s1\u00e9\u4e2d \n\t\r\x0b\x1c\x85\u00a0\u1680\u2003\u2028\u3000") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    ids = coder.encode_all(pa.array([*some, None], pa.string()))
    assert ids.to_pylist() == [*map(reference.encode_ordinary, some), []]
    assert bpe.StreamDecoder({r: t for t, r in ranks.items()}).decode_all(ids).to_pylist() == [*some, ""]


def test_bpe_kept_columns_of_any_name(spark, reference):
    docs = spark.createDataFrame([(1, "some text", "a", "b", "c")], "doc_id long, text string, ids string, given string, `c.0` string")
    out = bpe.encode(docs, vocab_path=VOCAB, pattern=public_tokenizers.PATTERN, keep=("doc_id", "ids", "given", "c.0"), decoded_col="text")
    assert out.columns == ["doc_id", "given", "c.0", "ids", "text"]
    assert tuple(out.first()) == (1, "b", "c", reference.encode_ordinary("some text"), "some text")
    back = bpe.decode(out.drop("text"), vocab_path=VOCAB, keep=("given",), text_col="t").first()
    assert tuple(back) == ("b", "some text")


def test_unigram_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = unigram.load_sentencepiece(path)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    reference = Tokenizer(Unigram(every, unk_id=0, byte_fallback=True))
    docs = spark.createDataFrame([(i, t, 1) for i, t in EDGES], "doc_id long, text string, n_tokens int")
    for r in unigram.counts(docs, vocabulary).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = r["text"]
        assert r["n_tokens"] == (len(reference.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)
    assert unigram.counts(docs.limit(0), vocabulary).count() == 0


def test_unigram_ties_and_unknown_runs():
    draw = random.Random(5)
    for fallback in (False,):
        pieces = {"".join(draw.choice("abc▁") for _ in range(draw.randint(1, 4))) for _ in range(60)}
        vocabulary = [("<unk>", -1.0), *((p, float(-draw.randint(1, 4))) for p in sorted(pieces))]
        counter = unigram.Counter(unigram.Vocabulary(tuple(vocabulary[1:]), min(s for _, s in vocabulary), fallback))
        reference = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        for _ in range(2000):
            text = "".join(draw.choice("abcz▁") for _ in range(draw.randint(0, 25)))
            assert counter.viterbi(text)[0] == len(reference.encode(text).ids)


def test_unigram_query_reads_all(spark):
    found = queries.op5_unigram_counts(spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


@pytest.mark.parametrize("how", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
def test_pages_round_trip(how, predictor, tile):
    for seed, rows in enumerate((1, 5, 130)):
        payload = random.Random(seed).randbytes(rows * 96) if seed % 2 else (b"aaaabc  " * rows * 12)
        (found,) = tiff.pages(tiff.write_page(payload, 96, how, predictor, tile, strip_rows=7))
        assert found["pixels"] == payload and found["error"] is None


def build(order: str, pages: list[dict], big: bool = False) -> bytes:
    """A file with several directories, of parts given already encoded."""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHH", 43, 8, 0) if big else struct.pack(order + "H", 42))
    out = bytearray(head + struct.pack(order + ("Q" if big else "I"), 0))
    link = len(out) - (8 if big else 4)
    for p in pages:
        where = len(out)
        out += p["data"]
        tags = sorted({256: p["w"], 257: p["h"], 258: p["bits"], 259: p["how"], 273: where, 277: p.get("samples", 1), 278: p["h"], 279: len(p["data"]), 317: p["predictor"], 284: p.get("planar", 1)}.items())
        at = len(out)
        struct.pack_into(order + ("Q" if big else "I"), out, link, at)
        out += struct.pack(order + ("Q" if big else "H"), len(tags))
        for tag, value in tags:
            out += struct.pack(order + ("HHQQ" if big else "HHII"), tag, 16 if big else 4, 1, value)
        link = len(out)
        out += bytes(8 if big else 4)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_several_pages_and_wide_samples(order, big):
    wide = np.arange(40, dtype=np.uint16).reshape(4, 10) * 777
    delta = np.diff(wide, axis=1, prepend=np.zeros((4, 1), np.uint16)).astype(np.dtype("u2").newbyteorder(order))
    real = np.linspace(-3, 9, 24, dtype=np.float32).reshape(3, 8)
    planes = np.stack([real.astype(">f4").view(np.uint8).reshape(3, 8, 4)[:, :, k] for k in range(4)], axis=1).reshape(3, 32)
    floats = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8)
    rgb = bytes(range(48))
    blob = build(order, [
        {"w": 10, "h": 4, "bits": 16, "how": 8, "predictor": 2, "data": zlib.compress(delta.tobytes())},
        {"w": 8, "h": 3, "bits": 32, "how": 5, "predictor": 3, "data": tiff.lzw_encode(floats.tobytes())},
        {"w": 4, "h": 4, "bits": 8, "how": 32773, "predictor": 1, "samples": 3, "data": tiff.packbits_encode(rgb)},
        {"w": 4, "h": 4, "bits": 8, "how": 7, "predictor": 1, "data": b"jpeg"},
    ], big)
    a, b, c, d = tiff.pages(blob)
    assert a["pixels"] == wide.astype(np.dtype("u2").newbyteorder(order)).tobytes()
    assert b["pixels"] == real.astype(np.dtype("f4").newbyteorder(order)).tobytes()
    assert c["pixels"] == rgb and [x["page"] for x in (a, b, c, d)] == [0, 1, 2, 3]
    assert "compression 7" in d["error"] and d.get("pixels") is None


def test_broken_files(spark):
    good = tiff.write_page(bytes(192), 96, tiff.LZW)
    loop = bytearray(build("<", [{"w": 4, "h": 1, "bits": 8, "how": 1, "predictor": 1, "data": b"abcd"}]))
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", loop, 4)[0])
    blobs = [(1, None), (2, b""), (3, b"II"), (4, good[:40]), (5, good), (5, good), (6, bytes(loop)), (7, good[:-3])]
    found = tiff.read_pages(spark.createDataFrame([(i, b, "z") for i, b in blobs], "doc_id int, file binary, page string"), "file").collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["page"] == -1 and by[i][0]["error"] for i in (1, 2, 3, 4))
    assert len(by[5]) == 2 and all(r["pixels"] == bytes(192) for r in by[5]) and len(by[6]) == 1
    assert by[7][0]["error"]


def test_text_media(spark):
    docs = spark.createDataFrame([(i, t, "b") for i, t in EDGES], "doc_id long, text string, blob string")
    got = {}
    for r in tiff.text_media(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in EDGES:
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        for r in got[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
    assert sum(map(len, got.values())) == len(EDGES) and got[3][0] == got[3][1]
    assert tiff.text_media(docs.where(F.lit(False))).count() == 0
