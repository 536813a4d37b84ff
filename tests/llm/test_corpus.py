"""Sharding, WARC, mixing, line chunks and near copies against brute force, and edge cases of each."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import jaccard, linededup, mixing, queries, sharding, store, warc
from vellumine.llm.components import components

SMALL = "/root/testdata/sf0.001"


def oracle(name: str):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = connection.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    return columns, Counter(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    columns, rows = oracle(name)
    assert Counter(tuple(r) for r in queries.QUERIES[name](spark, SMALL).select(*columns).collect()) == rows


# ---- sharding


def draw(key, shard):
    text = "null" if key is None else f"={key}"
    return (int(hashlib.md5(f"{text}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def test_shards_equal_brute_force_and_slots_have_no_gaps(spark):
    rows = [(i % 700, f"t{i % 5}" * (i % 9)) for i in range(1500)] + [(None, None)] * 3 + [(7, "same")] * 9000
    weights = [1.0, 2.5, 0.0, 0.5]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, shard int, size string")
    got = sharding.shard(df, "doc_id", "text", weights, added_weight=1.5).collect()
    assert len(got) == len(rows)
    places = {}
    for r in got:
        costs = {s: -math.log(draw(r["doc_id"], s)) / w for s, w in enumerate(weights) if w}
        best = min(costs, key=costs.get)
        moved = -math.log(draw(r["doc_id"], 4)) / 1.5 < costs[best]
        assert (r["shard"], r["grown_shard"], r["law"]) == (best, 4 if moved else best, "key")
        places.setdefault(best, []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(F.lit("a"), [0.0])


# ---- WARC


def test_archives_split_anywhere(spark, tmp_path):
    draw_ = random.Random(3)
    noise = "".join(chr(draw_.choice([0x1F, 0x8B, 8, 65, 233, 0x4E2D])) for _ in range(4000))
    pages = [(1, "http://a/\r\nx", "<p>" + "a" * 200), (2, "b", "<p>" + "a" * 200), (3, None, None), (4, "c", ""), (5, "d", noise), (6, "e", "short"), (7, "f", "short"), (None, "g", "<p>" + "a" * 200), (8, "h", "z" * 300_000), (2, "b", "<p>" + "a" * 200), (9, "i", noise)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    warc.write(warc.with_origins(df, "page_id", "url", "html"), path)
    seen = None
    for size in (64, 1000, 1 << 25):
        found = Counter((r["record_type"], r["record_id"], r["payload_bytes"], r["refers_to"], r["payload_digest"], hashlib.md5(r["payload"] or b"").hexdigest()) for r in warc.read(spark, path, range_bytes=size).collect())
        assert seen is None or found == seen
        seen = found
    assert sum(seen.values()) == len(pages)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_and_read(df).collect()}
    assert got == {(1, "response", None, 203), (2, "revisit", 1, 203), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, len(noise.encode())), (6, "response", None, 5), (7, "response", None, 5), (None, "revisit", 1, 203), (8, "response", None, 300_000), (9, "revisit", 5, len(noise.encode()))}


def test_reader_takes_no_false_member():
    inner = warc.member(b"not a record")
    data = warc.member(warc.record(1, "u", b"p" * 50, "d", None, "t")) + inner + b"junk\x1f\x8b\x08junk" + warc.member(warc.record(2, "u", b"q" * 50, "d", None, "t"))
    import io

    assert [warc.parse(d)[1][:1] for _, d in warc.records(io.BytesIO(data), 0, len(data))] == [b"p", b"q"]
    whole = [o for o, _ in warc.records(io.BytesIO(data), 0, len(data))]
    split = [o for s in range(0, len(data), 37) for o, _ in warc.records(io.BytesIO(data), s, min(s + 37, len(data)))]
    assert split == whole


def test_damaged_records_are_told(spark, tmp_path):
    whole = [warc.member(warc.record(i, "u", bytes(random.Random(i).randbytes(400)), "d", None, "t")) for i in (1, 2, 3)]
    (tmp_path / "w.gz").write_bytes(whole[0] + whole[1][:200] + whole[2] + whole[1][:-30])
    for size in (50, 1 << 20):
        found = sorted(map(tuple, warc.read(spark, str(tmp_path), range_bytes=size).select("offset", "record_id", "error").collect()))
        assert [(o, i) for o, i, _ in found] == [(0, "<urn:page:1>"), (len(whole[0]), None), (len(whole[0]) + 200, "<urn:page:3>"), (len(whole[0]) + 200 + len(whole[2]), None)]
        assert [e is None for _, _, e in found] == [True, False, True, False] and found[1][2].startswith("damaged record")


def test_page_ids_come_back_as_they_were(spark):
    names = ["a b", "<x>:\r\n", "é+%2F", None, "7"]
    pages = spark.createDataFrame([(n, "u", "<p>" + "a" * 200, "o") for n in names] + [("zz", None, "other", "o")], "page_id string, url string, html string, offset string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect()}
    assert got == {(n, "response" if n == "7" else "revisit", None if n == "7" else "7") for n in names} | {("zz", "response", None)}


def test_long_members_end_in_zero():
    member = warc.member(bytes(1 << 24) + b"x")
    assert member[-1] == 0 and zlib.decompressobj(31).decompress(member)[:3] == b"\0\0\0"


def test_empty_archive(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    capped = mixing.targets([10, 100, 100], [5, 2, 1])
    assert capped[0] == 30 and math.isclose(sum(capped), 210) and math.isclose(capped[1], 2 * capped[2])
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_flow_repeats_as_little_as_it_can():
    given = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 25, "b": 10})
    by = Counter()
    for (_, s), v in given.items():
        by[s] += v
    assert by == {"a": 25, "b": 10}
    assert given[1, "a"] + given[1, "b"] >= 10 and given[2, "b"] + given[1, "b"] == 10
    assert mixing.route([(("a",), 10)], {"a": 50})[0, "a"] == 30


def test_mix_meets_targets_and_agrees_with_itself(spark):
    draw_ = random.Random(9)
    rows = [(i, " ".join(["w"] * draw_.randint(1, 60)), draw_.choice(["a", "b", "é", None])) for i in range(900)] + [(1000, None, "a"), (1001, " \n ", "b"), (2000, "x y", "a"), (2000, "x y", "a")]
    df = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(5)).collect()))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    names = ["a", "b", "é", None]
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names], [5, 2, 1, 5]), strict=True))
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["source_size"], r["target"]) == (sizes[s], wanted[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] for s in names)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


@pytest.mark.parametrize("seed", ["mix", "a", "b", "c"])
def test_mix_passes_over_what_does_not_fit(spark, seed):
    draw_ = random.Random(5)
    rows = [(i, draw_.randint(80, 800), s) for s, n in (("a", 0), ("b", 1000)) for i in range(n, n + 400)] + [(2000 + i, 60_000 if i == 0 else 5_000, s) for s in "ab" for i in range(12)]
    # Rows that repeat an id come together or not at all.
    rows += [(5000 + k % 40, 300, "b") for k in range(120)]
    ids = [(i + (10_000 if s == "b" and 2000 <= i < 3000 else 0), n, s) for i, n, s in rows]
    df = spark.createDataFrame([(i, "w " * n, s) for i, n, s in ids], "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df, seed=seed).collect()
    per_id = {r["doc_id"]: r["copies"] for r in got}
    assert Counter((r["doc_id"], r["copies"]) for r in got) == Counter((i, per_id[i]) for i, _, _ in ids)
    together = Counter()
    for i, n, s in ids:
        together[s, i] += n
    for s in "ab":
        words = sum(n for (t, _), n in together.items() if t == s)
        quota = round(mixing.targets([sum(n for (t, _), n in together.items() if t == x) for x in "ab"], [5.0, 2.0])["ab".index(s)])
        whole, left = divmod(quota, words)
        for h, i in sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for t, i in together if t == s):
            taken = together[s, i] <= left
            left -= together[s, i] * taken
            assert per_id[i] == whole + taken
        assert left < 0.001 * quota
    assert Counter(r["doc_id"] for r in mixing.mixed(df, seed=seed).select("doc_id").collect()) == Counter({i: sum(per_id[j] for j, _, _ in ids if j == i) for i in per_id if per_id[i]})


def test_flow_over_overlapping_sources_costs_least():
    draw_ = random.Random(12)
    for _ in range(60):
        names = "abc"[: draw_.randint(1, 3)]
        patterns = [(members, draw_.randint(0, 3)) for n in range(1, len(names) + 1) for members in itertools.combinations(names, n) if draw_.random() < 0.8][:4]
        quotas = {s: draw_.randint(0, 5) for s in names}
        given = mixing.route(patterns, quotas)
        price = lambda used, words: sum(c * max(0, min(words, used - k * words)) for k, c in enumerate(mixing.REPEAT_COSTS))
        # All ways to hand out words by pattern and source.
        best = None
        edges = [(i, s) for i, (members, _) in enumerate(patterns) for s in members]
        for amounts in itertools.product(*[range(min(quotas[s], 3 * patterns[i][1]) + 1) for i, s in edges]):
            by_pattern, by_source = Counter(), Counter()
            for (i, s), v in zip(edges, amounts, strict=True):
                by_pattern[i] += v
                by_source[s] += v
            if any(by_pattern[i] > 3 * w for i, (_, w) in enumerate(patterns)) or any(by_source[s] > q for s, q in quotas.items()):
                continue
            worth = (-sum(amounts), sum(price(by_pattern[i], w) for i, (_, w) in enumerate(patterns)))
            best = worth if best is None else min(best, worth)
        used = Counter()
        for (i, _), v in given.items():
            used[i] += v
        assert (-sum(given.values()), sum(price(used[i], w) for i, (_, w) in enumerate(patterns))) == (best or (0, 0))


def test_mix_of_documents_in_several_sources(spark):
    draw_ = random.Random(13)
    rows = [(i, " ".join(["w"] * draw_.randint(1, 40)), draw_.sample(["a", "b", "c"], draw_.randint(1, 3))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    decided = mixing.plan(df, "doc_id", "text", F.col("sources"))
    got = {r["doc_id"]: r["__copies"] for r in decided.apply(df, "doc_id", F.col("sources"), size=mixing.word_count(F.col("text"))).collect()}
    sizes, total = Counter(), sum(len(t.split()) for _, t, _ in rows)
    for _, t, sources in rows:
        for s in sources:
            sizes[s] += len(t.split())
    assert decided.words == sizes and math.isclose(sum(decided.quotas.values()), total)
    taken = sum(got[i] * len(t.split()) for i, t, _ in rows)
    assert set(got) == {i for i, _, _ in rows} and max(got.values()) <= 3 and abs(taken - total) < 0.01 * total
    # What only one source holds cannot exceed that source's quota, nor all that it holds fall short of it.
    for s in "abc":
        alone = sum(got[i] * len(t.split()) for i, t, sources in rows if sources == [s])
        held = sum(got[i] * len(t.split()) for i, t, sources in rows if s in sources)
        assert alone <= 1.01 * decided.quotas[s] and held >= 0.99 * decided.quotas[s]


def test_mixed_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "x y z", "a", i, "p", 1) for i in range(20)], "doc_id long, text string, source string, __hash long, __pattern string, copy int")
    out = mixing.mixed(df)
    assert out.columns == df.columns and all(r["__hash"] == r["doc_id"] and r["__pattern"] == "p" for r in out.collect())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(r["copies"] for r in mixing.mix(wordless).collect()) == [1, 1]


# ---- line chunks


def brute_dedup(rows):
    ordered = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, result = set(), {}
    for i, t in ordered:
        lines = t.split("\n")
        written = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a, b in itertools.pairwise(written):
            pair = "\n".join(lines[a : b + 1])
            if pair in seen:
                gone.update(range(a, b + 1))
            seen.add(pair)
        result[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return Counter((i, None if t is None else result[i, t]) for i, t in rows)


def test_line_chunks_equal_brute_force(spark):
    draw_ = random.Random(2)
    passage = [f"shared line {k}" for k in range(12)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(draw_.randint(0, 6))] + [""] * draw_.randint(0, 2) + passage[: draw_.randint(0, 12)] + [" "] * draw_.randint(0, 1) + [f"end {draw_.randint(0, 3)}"] * draw_.randint(0, 4))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, " \n \n"), (204, "one"), (205, "x\n" * 20_000), (206, "\n\na\n\nb\n"), (207, "a\n\nb\n\n\na\nb"), (None, "\n".join(passage)), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "n", 1, "k") for i, t in rows], "doc_id long, text string, __k string, gone int, th string").repartition(4)
    out = linededup.dedup(df, removed_col="n")
    assert out.columns == ["doc_id", "text", "__k", "gone", "th", "n"]
    found = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == brute_dedup(rows)
    assert {(r["__k"], r["gone"], r["th"]) for r in found} == {("n", 1, "k")}
    assert all(r["n"] == len((dict(rows)[r["doc_id"]] or "").split("\n")) - len((r["text"] or "").split("\n")) for r in found if r["text"])
    assert linededup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("lines", [2, 3, 5, 40])
def test_a_moved_passage_goes_whole(spark, lines):
    passage = "\n".join(" ".join(f"passage{k}word{j}" for j in range(30)) for k in range(lines))
    df = spark.createDataFrame([(1, "head\n" + passage), (2, "other\nwords\nabove\n" + passage + "\nbelow"), (3, passage), (4, "clean\ntext\nof its own")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    assert left == {1: "head\n" + passage, 2: "other\nwords\nabove\nbelow", 3: "", 4: "clean\ntext\nof its own"}


# ---- near copies


def word_runs(text):
    words = []
    for token in (text or "").lower().split():
        places = [k for k, c in enumerate(token) if c.isalnum()]
        if places:
            words.append(token[places[0] : places[-1] + 1])
    width = min(5, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()


def brute_links(rows, threshold=0.8):
    sets = [word_runs(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
            links[a] += 1
            links[b] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(top(k), []).append(i)
    return Counter((i, min(x for x in ids[top(k)] if x is not None), links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [6, 256])
def test_near_copies_equal_brute_force(spark, block):
    draw_ = random.Random(4)
    base = [f"w{draw_.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(draw_.choice([0, 0, 1, 1, 2, 3])):
            words[draw_.randrange(150)] = f"n{draw_.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{draw_.randint(0, 10**6)}" for _ in range(draw_.randint(1, 80)))) for i in range(80)]
    rows += [(300, None), (301, ""), (302, "!!! ..."), (303, "one two"), (304, "One, two!"), (305, "one two three four five six"), (0, rows[0][1]), (306, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(df, block=block, recall=0.99999).collect())
    assert got == brute_links(rows)
    stays = jaccard.representatives(df, block=block, recall=0.99999)
    assert stays.columns == df.columns
    assert {r["doc_id"] for r in stays.collect()} == {c for _, c, _ in got}
    assert jaccard.join(df.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    words = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(1, words("a"), "x"), (2, words("a"), "x")]  # copies
    rows += [(2, words("b"), "x")]  # a clean document whose id another class has as well
    rows += [(3, words("c"), "x")] * 3 + [(3, words("c"), "y")] + [(4, words("c"), "x")]  # repeated rows of the least id
    rows += [(None, words("d"), "x"), (None, words("d"), "y"), (None, words("d").upper(), "x")]  # copies without an id
    rows += [(None, words("e"), "x"), (9, words("e"), "x")]  # an id goes before none
    rows += [(1, words("f"), "x"), (1, words("f") + " more", "x")]  # near copies of one id
    rows += [(7, None, "x"), (8, None, "x"), (7, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    stays = [tuple(r) for r in jaccard.representatives(df, recall=0.99999).collect()]
    assert set(stays) <= set(rows)
    classes = Counter((r[0], (r[1] or "none")[0].lower()) for r in stays)
    assert classes == Counter([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (9, "e"), (1, "f"), (7, "n")])
    assert sorted(stays, key=repr) == sorted(map(tuple, jaccard.representatives(df.repartition(5), recall=0.99999).collect()), key=repr)


def test_rows_that_repeat_one_text_and_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:57], "other"])
    rows = [(1, " ".join(words))] * 20_000 + [(2, near), (3, "clean text of its own words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter(map(tuple, jaccard.join(df, recall=0.99999).collect()))
    assert got == {(1, 1, 1, 20_000, 20_000): 20_000, (2, 1, 2, 1, 20_000): 1, (3, 3, 3, 1, 0): 1}


def test_bands_reach_their_recall():
    for threshold, recall in ((0.8, 0.999), (0.8, 0.9), (0.5, 0.99)):
        bands, rows = jaccard.choose_bands(threshold, recall, 128)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    draw_ = random.Random(6)
    edges = [(draw_.randrange(400), draw_.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(300)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: top(x) for x in joined}


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)], "a long, b long")
    assert dict(map(tuple, components(edges, "a", "b").collect())) == {1: 1, 2: 1}
    assert components(edges.limit(0), "a", "b").count() == 0


# ---- sessions and shared folders


def test_size_settings_and_bounds(spark):
    assert [store.size_setting(x) for x in ("64m", "67108864b", "1gb", "-1", "10K", " 7 ")] == [1 << 26, 1 << 26, 1 << 30, -1, 10_240, 7]
    with pytest.raises(ValueError):
        store.size_setting("much")
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[1], "64m")
        spark.conf.set(keys[0], "10000")
        jaccard.join(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
        assert [spark.conf.get(k) for k in keys] == ["10000", "64m"]
        store.bound_batches(spark)
        assert [spark.conf.get(k) for k in keys] == [str(store.BATCH_ROWS), str(store.BATCH_BYTES)]
        spark.conf.set(keys[0], "5")
        store.bound_batches(spark)
        assert spark.conf.get(keys[0]) == "5"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_slices_are_small_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (k * 100) for k in range(50)])], ["i", "t"])
    parts = list(store.slices(batch, rows=20, size=9000))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows == 1 or (p.num_rows <= 20 and p.nbytes <= 9000) for p in parts)


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        store.shared_dir(Cluster)
