"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds on the rest.

Vectors become whole numbers, floor(scale * x), and scores are exact integer inner products. Blocks hold
vectors of like length, longest first. A rotation from the eigenvectors of the table's second moments
(those of the SVD) puts most of every vector into its first coordinates; after some of them, the product
of what is left is at most the product of the remaining lengths, and pairs whose bound is below the
query's k-th best score so far go. Survivors are scored exactly.

Queries first meet the longest block, which gives each a lower bound, and then only those blocks whose
greatest length times their own can reach it. Queries go in sets by how far down they have to look, so a
vector is sent only to sets with a query that may want its block, and a group has one set and one block;
blocks and sets have a bounded size, and the driver sees no more than a row a class of length. Where the
partial sums leave much of a block, its scores come from one matrix product, if doubles hold them exactly.

Only vectors that are null or hold a null or non-finite component take no part, as queries or as candidates;
shorter vectors, empty ones too, count as padded by zeros. Whole components are kept as doubles, which hold
them exactly. Where a product of lengths could leave int64, the score is a sum of Python's integers; scores
travel as decimal text, so ranks are exact at any size. In the result a score beyond int64 is null, as the
column is a long; ``exact_col`` adds all digits as text. Rows that repeat an id are candidates
of their own, but none is a candidate for a query of the same id, which asks with its least vector.
Null ids are candidates and never queries; of equal scores the smaller id comes first, null last. Empty
tables give empty results.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.store import cut

SCALE = 256
#: Doubles of this size or more are whole; products of lengths below SAFE cannot leave int64.
WHOLE, SAFE = float(1 << 52), float(1 << 62)
#: Whole numbers below this are exact as doubles, in sums of any order.
EXACT = float(1 << 53)
#: Lengths fall into classes of this many to a doubling; neighbours share a block until it is full.
CLASSES = 16
#: Rows of a block, at least and at most: a table is cut into BLOCKS of them where these allow it.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS = 4096, 1 << 15, 64
#: Queries of a set; a task compares a slice of them at a time.
QUERY_ROWS, SLICE_ROWS = 8192, 1024


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Whole components as array<double>; null for vectors that take no part."""
    scaled = lambda x: x.cast("double") * scale
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(scaled(x)) < float("inf")))
    whole = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < WHOLE, F.floor(F.when(F.abs(scaled(x)) < WHOLE, scaled(x))).cast("double")).otherwise(scaled(x)))
    return F.when(vector.isNotNull() & ok, whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products over all vectors, greatest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width)
            with np.errstate(over="ignore", invalid="ignore"):
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select("v").mapInArrow(run, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros((width, width))
    for r in summed:
        moments[r["i"], r["j"]] = r["x"]
    if not np.isfinite(moments + moments.T).all():
        return np.eye(width)  # any rotation keeps the bounds; only how soon they tell is lost
    _, basis = np.linalg.eigh((moments + moments.T) / 2)
    return np.ascontiguousarray(basis[:, ::-1])


def _steps(width: int) -> list[int]:
    return sorted({max(1, width // 4), max(1, width // 2)})


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -score))[:k]


def _as_double(score: np.ndarray) -> np.ndarray:
    """Nearest doubles of whole scores; infinite beyond them."""
    if score.dtype != object:
        return score.astype(np.float64)
    return np.array([float(str(x)) for x in score], np.float64)


def _lengths(m: np.ndarray) -> np.ndarray:
    most = np.maximum(np.abs(m).max(axis=1, initial=0.0), 1.0)
    return np.linalg.norm(m / most[:, None], axis=1) * most


def _scores(q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs: int64, or Python's integers where a pair could leave it."""
    q_long, v_long = _lengths(q), _lengths(v)
    small = [np.where((long < SAFE)[:, None], m, 0.0).astype(np.int64) for m, long in ((q, q_long), (v, v_long))]
    out = np.concatenate([np.einsum("ij,ij->i", small[0][rows[s : s + 100_000]], small[1][cols[s : s + 100_000]]) for s in range(0, len(rows), 100_000)])
    large = np.flatnonzero((q_long[rows] * v_long[cols] >= SAFE) | (q_long[rows] >= SAFE) | (v_long[cols] >= SAFE))
    if len(large):
        out = out.astype(object)
        for i in large.tolist():
            out[i] = sum(int(a) * int(b) for a, b in zip(q[rows[i]].tolist(), v[cols[i]].tolist(), strict=True) if a and b)
    return out


@np.errstate(over="ignore", invalid="ignore")
def search_block(queries: tuple, block: tuple, basis: np.ndarray, k: int) -> list[tuple[int, int | None, int]]:
    """Candidates (query, vector, score) that can be in a top k, of one block of queries and one of vectors.

    ``queries``: ids, whole vectors, least scores to reach (-inf if none); ``block``: ids (with a mask of
    nulls) and whole vectors.
    """
    qid, q, bound = queries
    vid, missing, v = block
    v_long = _lengths(v)
    order = np.argsort(-v_long, kind="stable")
    vid, missing, v, v_long = vid[order], missing[order], v[order], v_long[order]
    q_long, qr, bound = _lengths(q), q @ basis, bound.copy()
    big = np.iinfo(np.int64).max
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qid]
    ranked = np.where(missing, big, vid)
    steps = _steps(q.shape[1])
    rest_q = [np.linalg.norm(qr[:, stop:], axis=1) for stop in steps]
    head_q = np.column_stack([qr[:, : steps[0]], rest_q[0], 1e-9 * np.linalg.norm(qr, axis=1)])
    for start in range(0, len(vid), 512):
        part, names = v[start : start + 512], ranked[start : start + 512]
        alive = np.flatnonzero(~(q_long * v_long[start] * (1 + 1e-9) + 1e-6 < bound))
        if not len(alive):
            break
        vr = part @ basis
        rest_v = [np.linalg.norm(vr[:, stop:], axis=1) for stop in steps]
        # Rounding of the rotated sums is far below the share of the lengths' product in the last column.
        head_v = np.column_stack([vr[:, : steps[0]], rest_v[0], np.linalg.norm(vr, axis=1)])
        rows, cols = np.nonzero(~(head_q[alive] @ head_v.T + 1e-6 < bound[alive][:, None]))
        dense = len(rows) * 16 > len(alive) * len(part) and q_long[alive].max() * v_long[start] < EXACT
        if dense:
            product = q[alive] @ part.T
            rows, cols = np.nonzero(product >= bound[alive][:, None])
            scores = product[rows, cols].astype(np.int64)
        rows = alive[rows]
        other = qid[rows] != names[cols]
        if dense:
            scores = scores[other]
        rows, cols = rows[other], cols[other]
        if not dense:
            for stop, left_q, left_v in zip(steps[1:], rest_q[1:], rest_v[1:], strict=True):
                slack = head_q[rows, -1] * head_v[cols, -1] + 1e-6
                partial = np.einsum("ij,ij->i", qr[rows, :stop], vr[cols, :stop]) + left_q[rows] * left_v[cols]
                kept = ~(partial + slack < bound[rows])
                rows, cols = rows[kept], cols[kept]
            if not len(rows):
                continue
            scores = _scores(q, part, rows, cols)
            good = _as_double(scores) >= bound[rows]
            rows, cols, scores = rows[good], cols[good], scores[good]
        for row, first, last in zip(*_runs(rows), strict=True):
            score = np.concatenate([held[row][0], scores[first:last]])
            name = np.concatenate([held[row][1], names[cols[first:last]]])
            top = _best(score, name, k)
            held[row] = score[top], name[top]
            if len(top) == k:
                bound[row] = max(bound[row], _as_double(score[top[-1:]])[0])
    return [(int(qid[r]), None if n == big else int(n), int(s)) for r, (score, name) in enumerate(held) for s, n in zip(score, name, strict=True)]


def _runs(rows: np.ndarray) -> tuple[list, list, list]:
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rows)][: len(starts)]


def search(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE, block_rows: int | None = None, exact_col: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, the ``k`` best other vectors; ``exact_col`` adds the score as text."""
    spark = table.sparkSession
    whole = table.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), quantised(F.col(vector_col), scale).alias("v")).where("v IS NOT NULL")
    most = F.greatest(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))), F.lit(1.0))
    length = F.least(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))) * F.col("most"), F.lit(sys.float_info.max))
    kind = F.floor(F.log2(F.greatest(F.col("length"), F.lit(1.0))) * CLASSES).cast("int")
    vectors = cut(whole.withColumn("most", most).withColumn("length", length).drop("most").withColumn("kind", kind))
    found = vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most"), F.max(F.size("v")).alias("width")).orderBy(F.desc("kind")).collect()
    empty = "query_id long, rank int, vec_id long, score long" + (f", `{exact_col}` string" if exact_col else "")
    if not found:
        return spark.createDataFrame([], empty)
    width = max(r["width"] for r in found)
    block_rows = block_rows or min(max(math.ceil(sum(r["n"] for r in found) / BLOCKS), BLOCK_ROWS), MOST_BLOCK_ROWS)
    # Bands of neighbouring classes, longest first, each of a block or more: (kinds, greatest length, rows).
    bands: list[tuple[list[int], float, int]] = []
    for r in found:
        if bands and bands[-1][2] < block_rows:
            bands[-1] = (bands[-1][0] + [r["kind"]], max(bands[-1][1], r["most"]), bands[-1][2] + r["n"])
        else:
            bands.append(([r["kind"]], r["most"], r["n"]))
    first, layout = 0, []
    for place, (_, _, n) in enumerate(bands):
        count = math.ceil(n / block_rows)
        layout.append((place, first, count))
        first += count
    basis, blocks = rotation(vectors, width), first
    # One row a length class: a few thousand at most, as lengths are doubles.
    kinds = [(kind, *layout[place]) for place, (members, _, _) in enumerate(bands) for kind in members]
    placed = vectors.join(F.broadcast(spark.createDataFrame(kinds, "kind int, band int, first int, count int")), "kind")
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("count")).cast("int"))
    asked_once = vectors.where("is_query AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("v", "length")).alias("q"))
    queries = cut(asked_once.select("id", "q.v", "q.length"))
    sets = max(1, math.ceil(queries.count() / QUERY_ROWS))
    queries = queries.withColumn("set", F.pmod(F.xxhash64("id"), F.lit(sets)).cast("int"))
    result = "query_id long, vec_id long, score string"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = left.column("id").to_numpy(), right.column("vec").combine_chunks()
        out = []
        if len(ids) and len(names):
            bound = left.column("bound").to_numpy().astype(np.float64)
            missing = names.is_null().to_numpy(zero_copy_only=False)
            vid = names.fill_null(0).to_numpy()
            q, v = (_matrix(column.combine_chunks(), width) for column in (left.column("v"), right.column("w")))
            for s in range(0, len(ids), SLICE_ROWS):
                out += search_block((ids[s : s + SLICE_ROWS], q[s : s + SLICE_ROWS], bound[s : s + SLICE_ROWS]), (vid, missing, v), basis, k)
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array([str(x) for x in c], pa.string())})

    def pairs(asked: DataFrame, among: DataFrame, least: Column, sets: int) -> DataFrame:
        """``asked`` has (id, v, bound, set, block); ``among`` (id, v, block), sent to the sets from ``least`` on."""
        spread = among.select(F.col("id").alias("vec"), F.col("v").alias("w"), F.col("block").alias("among_block"), F.explode(F.sequence(least, F.lit(sets - 1))).alias("among_set"))
        # By number: groups are small in bytes and long in work, so they are not to be put together by their bytes.
        tasks = min(sets * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        left, right = asked.repartition(tasks, "set", "block"), spread.repartition(tasks, "among_set", "among_block")
        return left.groupBy("set", "block").cogroup(right.groupBy("among_set", "among_block")).applyInArrow(meet, result)

    def ranked(candidates: DataFrame) -> DataFrame:
        below, digits = F.col("score").startswith("-"), F.length("score")
        falling = (F.desc(F.when(below, -digits).otherwise(digits)), F.desc(F.when(~below, F.col("score"))), F.asc(F.when(below, F.col("score"))))
        order = Window.partitionBy("query_id").orderBy(*falling, F.asc_nulls_last("vec_id"))
        return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    start = queries.select("id", "v", F.lit(float("-inf")).alias("bound"), "set", F.lit(0).alias("block"))
    longest = cut(ranked(pairs(start, placed.where("block = 0"), F.lit(0), sets)))
    bounds = longest.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound")).distinct()
    bounded = queries.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    columns = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.expr("try_cast(score AS bigint)").alias("score"), *([F.col("score").alias(exact_col)] if exact_col else [])]
    if blocks == 1:
        return longest.select(*columns)
    # Bands in falling order of length: a query looks down to the last one that can matter.
    reached = [F.when(F.lit(most) * F.col("length") * (1 + 1e-9) + 1e-6 >= F.col("bound"), F.lit(place)) for place, (_, most, _) in enumerate(bands)]
    sent = cut(bounded.withColumn("last", F.coalesce(F.array_max(F.array(*reached)), F.lit(0))))
    depths = sorted((r["last"], r["count"]) for r in sent.groupBy("last").count().collect())
    # Depths in runs that fill a set or more: (depth, first set, sets), and for each band the first set that looks so far.
    runs, open_, held, sets = [], [], 0, 0
    for depth, n in depths:
        open_.append(depth)
        held += n
        if held >= QUERY_ROWS or depth == depths[-1][0]:
            runs.append((open_, sets, math.ceil(held / QUERY_ROWS)))
            sets += runs[-1][2]
            open_, held = [], 0
    least = [next((start for run, start, _ in runs if run[-1] >= place), sets) for place in range(len(bands))]
    dealt = spark.createDataFrame([(d, start, count) for run, start, count in runs for d in run], "last int, start int, sets int")
    ends = F.array(*[F.lit(start + count - 1) for _, start, count in layout])
    asked = sent.join(F.broadcast(dealt), "last").withColumn("set", F.col("start") + F.pmod(F.xxhash64("id"), F.col("sets")).cast("int")).withColumn("end", F.get(ends, F.col("last"))).where("end >= 1")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("end")))).select("id", "v", "bound", "set", "block")
    among = placed.where("block > 0").withColumn("least", F.get(F.array(*[F.lit(x) for x in least]), F.col("band"))).where(F.col("least") < sets)
    rest = pairs(asked, among, F.col("least"), sets)
    merged = longest.select("query_id", "vec_id", "score").unionByName(rest)
    return ranked(merged).select(*columns)
