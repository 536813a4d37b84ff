"""Quality scores by attention over passages, learnt from document labels alone.

A text is cut into passages of ``PASSAGE_WORDS`` words. A passage is described by how often each pair of
character kinds follows one another, by hashed words, and by a few ratios, one of them over the whole
text; a dense layer encodes it, gated attention (tanh and sigmoid branches) weighs the passages of a
document, and the weighted representation gives the score. All passages of a text count in fitting and
in scoring, however long it is; long texts are described part by part, with the same result.

The model is fitted on labelled documents in the order of the hashes of their ids: at most
``train_docs`` of them, with at most ``train_passages`` passages in all. A document is taken with all its
passages or, where these no longer fit, passed over. Both are parameters and bound what reaches the
driver. Only rows whose crc32 of the id's text is not 1 modulo 3 are used for fitting; label, language,
source and id never enter a score.

Nulls and empty texts are one passage without words, and have a score too. Without labels of both kinds
the score is the share of label 1, or one half. Labels of a repeated id: the greatest; a labelled id that
several rows repeat is learnt from its text of the least hash. Repeated rows give equal rows; extra columns pass
through only where named; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.store import Shared, cut, slices

PASSAGE_WORDS = 64
WORD_BUCKETS = 64
KINDS = 16
STATS = 6
WIDTH = KINDS * KINDS + WORD_BUCKETS + STATS
#: Place of the one ratio that is taken over the whole text.
DISTINCT = WIDTH - 2
#: Long texts are described in parts of about this.
BLOCK_BYTES = 1 << 20
HIDDEN, GATE = 32, 16
TRAIN_DOCS, TRAIN_PASSAGES, EPOCHS = 4000, 60_000, 25


def _kinds() -> np.ndarray:
    """Kind of each byte: white space, letters, digits, other alphabets, single marks, the rest."""
    table = np.full(256, 15, np.uint8)
    table[list(b" \t\r\x0b\x0c")] = 0
    table[ord("\n")] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[128:] = 5
    for kind, marks in enumerate((b".", b",", b"!", b"?", b"'\"", b"()[]{}<>", b"#$%&*@^~", b"-_/\\|", b":;"), 6):
        table[list(marks)] = kind
    return table


_KIND = _kinds()
_POWERS = np.cumprod(np.full(64, 1099511628211, np.uint64), dtype=np.uint64)


def _describe(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages between ``borders``, but for the text's own ratio, and the hashes of their words."""
    low, high = int(borders[0]), int(borders[-1])
    before = kind[low - 1 : high] if low else np.concatenate((kind[:1], kind[:high]))
    data, kind, starts = data[low:high], kind[low:high], starts - low
    lengths = np.diff(borders)
    passages, words = len(lengths), len(starts)
    passage = np.repeat(np.arange(passages), lengths)
    pair = before[:-1].astype(np.int64) * KINDS + before[1:]
    inner = slice(0 if low else 1, None)
    pairs = np.bincount(passage[inner] * (KINDS * KINDS) + pair[inner], minlength=passages * KINDS * KINDS).reshape(passages, -1)
    # A word's hash: its bytes by powers of a prime; white space adds nothing.
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
    value = np.where(kind > 1, data.astype(np.uint64) * _POWERS[place & 63], np.uint64(0))
    hashes = np.add.reduceat(value, starts)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    of = np.arange(words) // PASSAGE_WORDS
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    bags = np.bincount(of * WORD_BUCKETS + bucket, minlength=passages * WORD_BUCKETS).reshape(passages, -1)
    count = np.bincount(of, minlength=passages).astype(np.float64)
    distinct = np.bincount((np.unique((hashes >> np.uint64(24)) | (of.astype(np.uint64) << np.uint64(40))) >> np.uint64(40)).astype(np.int64), minlength=passages)
    share = lambda k: np.bincount(passage, weights=np.isin(kind, k), minlength=passages) / lengths
    stats = np.stack([lengths / count / 10, distinct / count, share((3,)), share((8, 12)), np.zeros(passages), np.zeros(passages)], axis=1)
    return np.concatenate([np.sqrt(pairs / lengths[:, None]), np.sqrt(bags / count[:, None]), stats], axis=1).astype(np.float32), hashes


def features(text: str | None) -> np.ndarray:
    """A row per passage; long texts part by part, each part whole passages."""
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    kind = _KIND[data]
    solid = kind > 1
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    words = len(starts)
    if not words:
        out = np.zeros((1, WIDTH), np.float32)
        out[0, -1] = 1.0
        return out
    borders = np.append(starts[::PASSAGE_WORDS], len(data))
    borders[0] = 0
    parts, seen, at, passages = [], np.empty(0, np.uint64), 0, len(borders) - 1
    while at < passages:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + BLOCK_BYTES, side="right")) - 1)
        part, hashes = _describe(data, kind, starts[at * PASSAGE_WORDS : to * PASSAGE_WORDS], borders[at : to + 1])
        parts.append(part)
        seen = np.unique(np.concatenate((seen, hashes)))
        at = to
    out = np.concatenate(parts) if len(parts) > 1 else parts[0]
    out[:, DISTINCT] = len(seen) / words
    return out


class Model:
    """Encoder, gated attention and score, with gradients by hand."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        init = lambda a, b: (draw.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1), "c": init(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """``x``: all passages; ``starts``: where each document begins."""
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        s = ((t * g) @ p["w"])[:, 0]
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(s - np.maximum.reduceat(s, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(h * a[:, None], starts)
        logit = (z @ p["c"])[:, 0] + p["d"][0]
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "of": of, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        return self.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])["score"].astype(np.float64)

    def gradients(self, r: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        p, of = self.p, r["of"]
        dl = ((r["score"] - y) / len(y)).astype(np.float32)
        out = {"c": r["z"].T @ dl[:, None], "d": dl.sum(keepdims=True)}
        dz = dl[:, None] * p["c"][:, 0]
        da = (r["h"] * dz[of]).sum(1)
        ds = r["a"] * (da - np.add.reduceat(r["a"] * da, starts)[of])
        dh = r["a"][:, None] * dz[of]
        tg = r["t"] * r["g"]
        out["w"] = tg.T @ ds[:, None]
        dtg = ds[:, None] * p["w"][:, 0]
        dt, dg = dtg * r["g"] * (1 - r["t"] ** 2), dtg * tg * (1 - r["g"])
        out["V"], out["U"] = r["h"].T @ dt, r["h"].T @ dg
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (r["h"] > 0)
        out["W"], out["b"] = r["x"].T @ dh, dh.sum(0)
        return out


def fit(bags: list[np.ndarray], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = 3e-3, decay: float = 1e-4, batch: int = 64, seed: int = 5) -> Model:
    """Adam over batches of documents, in an order that the seed fixes."""
    every = np.concatenate(bags)
    model = Model(every.mean(0), (1 / (every.std(0) + 1e-2)).astype(np.float32))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    draw, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = draw.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            starts = np.cumsum([0, *(len(bags[i]) for i in some)])[:-1]
            result = model.forward(np.concatenate([bags[i] for i in some]), starts)
            step += 1
            for k, g in model.gradients(result, labels[some].astype(np.float32), starts).items():
                g = g + decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> Model | float:
    """A model, or the share of label 1 where there are not labels of both kinds."""
    allowed = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    order = F.md5(F.col("id").cast("string"))
    chosen = allowed.groupBy("id").agg(F.max("y").alias("y")).withColumn("rank", order).orderBy("rank", "id").limit(train_docs)
    # At most train_docs rows go out to all, and one row an id comes back.
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
    rows = found.groupBy("id", "y", "rank").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")).select("rank", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bags = [features(text.as_py()) for text in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, bags), pa.int64()), pa.array([bag.tobytes() for bag in bags], pa.binary())], ["rank", "y", "n", "bag"])

    bags = cut(rows.mapInArrow(run, "rank string, y int, n long, bag binary"))
    taken, room = [], train_passages
    for r in sorted(bags.select("rank", "n").collect()):
        if r["n"] <= room:
            taken.append((r["rank"],))
            room -= r["n"]
    if not taken:
        return 0.5
    within = bags.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "rank string")), "rank")
    held = sorted(within.select("rank", "y", "bag").collect(), key=lambda r: r["rank"])
    y = np.array([r["y"] for r in held])
    if len(set(y.tolist())) < 2:
        return float(y.mean())
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in held], y)


def score(docs: DataFrame, model: Model | float, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``keep`` columns and the score of each whole text."""
    if isinstance(model, float):
        return docs.select(*keep, F.lit(model).alias(score_col))
    shared = Shared(docs.sparkSession, model)
    names = [f"c{i}" for i in range(len(keep) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch):
                scores, bags, held = [], [], 0
                for text in part.column(len(keep)):
                    bags.append(features(text.as_py()))
                    held += len(bags[-1])
                    if held > 4096:
                        scores.append(net.scores(bags))
                        bags, held = [], 0
                scores.append(net.scores(bags))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.concatenate(scores))], names)

    slim = docs.select(*keep, F.col(text_col)).toDF(*names)
    fields = T.StructType([*slim.schema.fields[:-1], T.StructField(names[-1], T.DoubleType())])
    return slim.mapInArrow(run, fields).toDF(*keep, score_col)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those of a score below one half."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*columns)
    scored = score(inner, train(docs, labels, text_col=text_col, **options), keep=tuple(columns), text_col=columns[docs.columns.index(text_col)], score_col="score")
    return scored.where("score >= 0.5").drop("score").toDF(*docs.columns)
