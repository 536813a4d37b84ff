"""Top-k search against brute force, the classifier on held-out labels, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_corpus import brute_dedup, brute_links
from vellumine.llm import bpe, jaccard, mil, mixing, topk

SMALL = "/root/testdata/sf0.001"


def test_topk_equals_brute_force(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(1200, 12)) * np.exp(draw.normal(size=(1200, 1))) * np.linspace(2, 0.1, 12)
    x[100:500] = x[0]
    rows = [(i, [float(v) for v in r], "s") for i, r in enumerate(x)] + [(5000, None, ""), (5050, [1.0, None], ""), (5100, [float("nan")] * 12, ""), (5150, [], ""), (None, [3.0] * 12, ""), (5200, [1.0] * 3, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.search(table, F.col("vec_id") % 50 == 0, block_rows=150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if v and all(c is not None and c == c for c in v)]
    whole = [(i, np.pad(v, (0, 12 - len(v)))) for i, v in whole]
    for q, v in whole:
        if q is None or q % 50:
            continue
        best = sorted((-int(v @ w), i is None, i or 0, i) for i, w in whole if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, b[3], -b[0]) for k, b in enumerate(best)]
    twice = table.where("vec_id < 3").unionByName(table.where("vec_id = 1")).withColumn("vec_id", F.col("vec_id") * 50).unionByName(table.where("vec_id = 0"))
    found = [(r["query_id"], r["vec_id"]) for r in topk.search(twice, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(found) == [(0, 50), (0, 50), (0, 100), (50, 0), (50, 0), (50, 100), (100, 0), (100, 0), (100, 50), (100, 50)]
    few = topk.search(table.where("vec_id IN (0, 50)"), F.col("vec_id") % 50 == 0)
    assert sorted((r["query_id"], r["vec_id"]) for r in few.collect()) == [(0, 50), (50, 0)]
    assert topk.search(table.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_topk_keeps_every_finite_vector(spark, block_rows):
    draw = random.Random(8)
    # Floats up to 1e38, doubles up to 1e300, sums that int64 cannot hold, empty vectors; scores differ in their last digits.
    vectors = [[draw.uniform(-1, 1) * 10 ** draw.choice([0, 0, 3, 6.5, 8, 17, 38, 150, 300]) for _ in range(8)] for _ in range(60)]
    vectors += [[4_194_303.0 + d / 256] * 8 for d in range(5)] + [[5e6] * 8, [-5e6] * 8, [1e17] * 8, [], [0.0] * 8, [-1.0]]
    lost = [None, [1.0, None], [float("nan")] * 8, [float("inf")] * 8]
    df = spark.createDataFrame(list(enumerate(vectors + lost)), "vec_id long, embedding array<double>").repartition(3)
    whole = [[math.floor(Fraction(x) * 256) for x in v] for v in vectors]
    expected = []
    for a in range(len(whole)):
        scores = sorted((-sum(x * y for x, y in zip(whole[a], whole[b], strict=False)), b) for b in range(len(whole)) if a != b)
        expected += [(a, k + 1, b, -s if abs(s) < 2**63 else None, str(-s)) for k, (s, b) in enumerate(scores[:5])]
    got = topk.search(df, F.lit(True), block_rows=block_rows, exact_col="exact").collect()
    assert sorted(map(tuple, got)) == expected


@pytest.mark.parametrize("others", [0, 40])
def test_topk_block_whose_survivors_all_miss_the_bound(others):
    # Partial sums cannot rule the first vector out, its score does; with 40 others, few pairs survive.
    v = np.array([[0.0, 0, 0, 1], *[[-9.0, 0, 0, 0]] * others])
    block = (np.arange(1, len(v) + 1), np.zeros(len(v), bool), v)
    assert topk.search_block((np.array([0]), np.array([[1.0, 0, 1, 0]]), np.array([0.5])), block, np.eye(4), 5) == []
    assert topk.search_block((np.array([0]), np.array([[1.0, 0, 1, 0]]), np.array([0.0])), block, np.eye(4), 5) == [(0, 1, 0)]


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(1)
    model = mil.Model(np.zeros(mil.WIDTH, np.float32), np.ones(mil.WIDTH, np.float32))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    bags, y, starts = draw.normal(size=(7, mil.WIDTH)) * 0.3, np.array([1.0, 0.0]), np.array([0, 4])

    def loss():
        s = model.forward(bags, starts)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    slopes = model.gradients(model.forward(bags, starts), y, starts)
    for name, value in model.p.items():
        at = tuple(draw.integers(0, n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-6
        up = loss()
        value[at] = old - 1e-6
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-6 - slopes[name][at]) < 1e-4 * max(1, abs(slopes[name][at])) + 1e-5


def plain_score(model, bag):
    """One document's score, passage by passage."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    states, weights = [], []
    for row in bag.astype(float):
        x = (row - model.mean) * model.scale
        h = np.array([max(0.0, float(x @ p["W"][:, j] + p["b"][j])) for j in range(mil.HIDDEN)])
        gate = [math.tanh(float(h @ p["V"][:, j])) / (1 + math.exp(-float(h @ p["U"][:, j]))) for j in range(mil.GATE)]
        states.append(h)
        weights.append(math.exp(sum(g * float(p["w"][j, 0]) for j, g in enumerate(gate))))
    mixed = sum(w * h for w, h in zip(weights, states, strict=True)) / sum(weights)
    return 1 / (1 + math.exp(-(float(mixed @ p["c"][:, 0]) + float(p["d"][0]))))


def test_scores_equal_a_plain_computation(spark):
    texts = ["a word or two", "", None, "Many words, of many kinds! 12 {x}. " * 300, "é ü " * 90, " \n\n lead " + "z " * 64]
    bags = [mil.features(t) for t in texts]
    model = mil.fit(bags, np.array([1, 0, 0, 1, 0, 1]), epochs=3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in mil.score(docs, model).collect()}
    assert all(abs(got[i] - plain_score(model, bag)) < 1e-4 for i, bag in enumerate(bags))


def test_features_do_not_depend_on_the_size_of_parts(monkeypatch):
    draw = random.Random(3)
    text = " ".join("".join(draw.choice("abcXYZ.,!{}1é\n") for _ in range(draw.randint(1, 12))) for _ in range(60_000))
    in_parts = mil.features("  \n" + text)
    monkeypatch.setattr(mil, "BLOCK_BYTES", 1 << 30)
    whole = mil.features("  \n" + text)
    monkeypatch.setattr(mil, "BLOCK_BYTES", 1)
    assert np.array_equal(in_parts, whole) and np.array_equal(mil.features("  \n" + text), whole)


def test_fitting_takes_whole_documents_within_its_bounds(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(mil, "fit", lambda bags, y: seen.update(bags=[len(b) for b in bags], y=y.tolist()) or 0.25)
    docs = spark.createDataFrame([(i, "word " * (64 * (i % 7 + 1))) for i in range(60)] + [(0, "other " * 64)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    chosen = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    mil.train(docs, labels, train_docs=9)
    assert seen["y"] == [i % 2 for i in chosen[:9]] and all(n == i % 7 + 1 for n, i in zip(seen["bags"], chosen[:9], strict=True) if i)
    mil.train(docs, labels, train_docs=30, train_passages=45)
    taken, room = [], 45
    for i in chosen[:30]:
        if i % 7 + 1 <= room:
            taken.append(i % 7 + 1)
            room -= taken[-1]
    assert seen["bags"] == taken


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = mil.quality(docs, labels).cache()
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored.select("doc_id", "held_out").collect())
    held = scored.where("held_out").join(labels, "doc_id")
    right, n = held.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.97
    again = mil.quality(docs.repartition(7), labels.repartition(3))
    assert again.join(scored.select("doc_id", F.col("score").alias("before")), "doc_id").where("abs(score - before) > 0.05").count() == 0
    scored.unpersist()


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (4, "word " * 300_000, "d"), (4, "ω" * 50, "e")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in mil.quality(docs, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, None), (None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert mil.quality(docs, labels).count() == 5
    assert mil.keep_good(docs, labels).columns == docs.columns
    assert mil.quality(docs.limit(0), labels).count() == 0
    bag = mil.features("ab cd " * 400_000)
    assert np.isfinite(bag).all() and abs(len(bag) - 12_500) < 5


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stage(spark, docs, SMALL).cache()
        if name != "tokens":
            assert docs.columns == seen["quality"].columns and docs.schema["n_chars"].dataType == seen["quality"].schema["n_chars"].dataType
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    good = mil.keep_good(seen["quality"], spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert Counter_(pairs(seen["lines"])) == Counter_(pairs(good))
    assert Counter_(pairs(seen["near_copies"])) == brute_dedup(pairs(seen["lines"]))
    assert all(r["n_chars"] == len(r["text"]) for r in seen["near_copies"].collect())
    classes = {c for _, c, _ in brute_links(pairs(seen["near_copies"]))}
    assert {i for i, _ in pairs(seen["mix"])} == classes
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["mix"]).collect()}
    assert Counter_(i for i, _ in pairs(seen["tokens"])) == {i: n for i, n in copies.items() if n}
    with open(corpus_pipeline.VOCAB, "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    text = dict(pairs(seen["tokens"]))
    for r in docs.collect():
        assert r["ids"] == coder.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows and ids, clashing names, no n_chars, and an empty table, through every stage."""
    words = lambda k, n=40: " ".join(f"{k}w{j}" for j in range(n))
    rows = [(1, words("a"), "s"), (1, words("a"), "s"), (2, None, None), (3, "", "s"), (None, words("b"), "t"), (5, words("c", 90_000), "t"), (6, words("d") + "\n" + words("e"), "t"), (7, words("d") + "\n" + words("e") + "\nmore", "t"), (7, words("f"), "s")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clash = "doc_id long, text string, source string, score double, gone string, copy int, __k string, ids string, th long"
    docs = spark.createDataFrame([(*r, 0.1, "g", 2, "k", "i", 3) for r in rows], clash)
    for part in (docs, docs.limit(0)):
        now = part
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path)).cache()
            if name != "tokens":
                assert now.columns == docs.columns and all((r["gone"], r["copy"], r["__k"], r["ids"], r["th"]) == ("g", 2, "k", "i", 3) for r in now.collect())
        assert now.columns == ["doc_id", "source", "score", "gone", "copy", "__k", "th", "n_tokens", "ids", "decoded_sha256"]
        assert (now.count() > 0) == (part is docs)
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, corpus_pipeline.lines(spark, docs, ""), "").collect()}
    assert kept == {None, 1, 2, 5, 6, 7}


def Counter_(items):
    from collections import Counter

    return Counter(items)


def test_pipeline_is_registered():
    assert "pipeline" in __spark_entry__.queries()
    assert sum(k.startswith("op") for k in __spark_entry__.queries()) == 10
    assert jaccard.WORDS == 5 and jaccard.THRESHOLD == 0.8
