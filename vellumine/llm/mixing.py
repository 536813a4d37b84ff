"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns.

Documents are added up by pattern, the set of sources that hold them. Every source has a quota of
words; a pattern offers its words once at no cost, again at growing costs, up to a number of
repetitions. The flow of least cost that fills the quotas says how many words each pattern gives. A
pattern that gives so many times all its words and some more takes all documents so often, and once
more, in the order of seeded hashes, every document that still fits: one that does not is passed over
and the next ones are looked at, until none fits. The choice is a few runs a pattern, each a range of
hashes and the most words a document in it may have, so applying it to any table of documents needs no
shuffle; only where ids repeat are the words of their rows looked up.

Only sums by pattern reach the driver: at most ``max_patterns`` rows, else an error; nothing is
dropped. Null source is a source of its own and orders last; null texts have no words, and a document
without words is taken once. Rows that repeat an id are taken together. Empty tables give empty
results; other columns play no part.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.store import cut, lookup_join

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: What a document's first, second and third copy cost.
REPEAT_COSTS = (0, 1, 3)
HEX_DIGITS = 3
#: Orders behind every hash.
LAST_HASH = "g"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its size, the excess shared anew."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


class Flow:
    """Successive shortest paths; arcs with whole capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for at, end, capacity, price in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[at].append(len(self.to))
            self.to.append(end)
            self.room.append(capacity)
            self.cost.append(price)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, start: int, end: int) -> None:
        while True:
            far, via = {start: 0}, {}
            line, queued = deque([start]), {start}
            while line:
                a = line.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    if self.room[e] > 0 and far[a] + self.cost[e] < far.get(self.to[e], 1 << 60):
                        far[self.to[e]], via[self.to[e]] = far[a] + self.cost[e], e
                        if self.to[e] not in queued:
                            queued.add(self.to[e])
                            line.append(self.to[e])
            if end not in via:
                return
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def route(patterns: list[tuple[tuple, int]], quotas: dict, costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple[int, object], int]:
    """Words that each pattern (members, words) gives each of its sources: (pattern's index, source) -> words."""
    names = list(quotas)
    first_source = 1 + len(patterns)
    flow = Flow(first_source + len(names) + 1)
    end = first_source + len(names)
    edges = {}
    for i, (members, words) in enumerate(patterns):
        for cost in costs:
            flow.arc(0, 1 + i, words, cost)
        for source in members:
            edges[i, source] = flow.arc(1 + i, first_source + names.index(source), words * len(costs), 0)
    for k, source in enumerate(names):
        flow.arc(first_source + k, end, quotas[source], 0)
    flow.run(0, end)
    return {at: flow.used(arc) for at, arc in edges.items()}


@dataclass
class Mix:
    """What was decided: ``rules`` has a row a pattern; ``slim`` a row a document, without its text.

    ``repeated`` has the hashes that several documents share, with the words of all of them; None if there are none.
    """

    rules: DataFrame
    slim: DataFrame
    repeated: DataFrame | None
    words: dict
    quotas: dict
    seed: str

    def apply(self, df: DataFrame, id_col: str, members: Column, *, size: Column) -> DataFrame:
        """``df`` with ``__copies``: how often each document, of ``size`` words, is taken."""
        keyed = df.withColumns({"__pattern": pattern_key(members), "__hash": seeded(F.col(id_col), self.seed), "__own": size})
        if self.repeated is None:
            keyed = keyed.withColumn("__together", F.col("__own"))
        else:
            total = self.repeated.agg(F.sum("n")).first()[0]
            keyed = lookup_join(keyed, self.repeated, ["__pattern", "__hash"], "n", total, F.rand(), how="left").withColumn("__together", F.coalesce("__words", "__own")).drop("__words")
        # At most max_patterns rules, checked when they were made.
        joined = keyed.join(F.broadcast(self.rules), "__pattern", "left")
        more = F.exists("__runs", lambda r: (F.col("__hash") > r["after"]) & (F.col("__hash") <= r["upto"]) & (F.col("__together") <= r["most"]))
        copies = F.coalesce(F.col("__all") + F.coalesce(more, F.lit(False)).cast("int"), F.lit(0))
        return joined.withColumn("__copies", F.when(F.col("__own") == 0, F.lit(1)).otherwise(copies)).drop("__pattern", "__hash", "__own", "__together", "__runs", "__all")


def pattern_key(members: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(members)))


def seeded(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))


def plan(docs: DataFrame, id_col: str, text_col: str, members: Column, *, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, max_patterns: int = 20_000) -> Mix:
    """Decides the mix over all of ``docs``; ``members`` is the array of a document's sources."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.array_sort(F.array_distinct(members)).alias("__members"), word_count(F.col(text_col)).alias("__size"))
    slim = cut(rows.withColumns({"__pattern": pattern_key(F.col("__members")), "__hash": seeded(F.col("__id"), seed)}))
    found = slim.groupBy("__pattern", "__members").agg(F.sum("__size").alias("words")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} sets of sources; group the sources first")
    found.sort(key=lambda r: r["__pattern"])
    patterns = [(tuple(r["__members"] or ()), int(r["words"])) for r in found]
    names = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for m, w in patterns if s in m) for s in names]
    total = sum(w for _, w in patterns)
    scale = [float(weights[i % len(weights)]) for i in range(len(names))]
    wanted = targets(sizes, scale) if total == sum(sizes) else _overlapping_targets(total, sizes, scale)
    quotas = dict(zip(names, wanted, strict=True))
    given = route(patterns, {s: round(t) for s, t in quotas.items()})
    rules = []
    for i, (row, (_, words)) in enumerate(zip(found, patterns, strict=True)):
        amount = sum(v for (k, _), v in given.items() if k == i)
        whole, rest = divmod(amount, words) if words else (0, 0)
        rules.append((row["__pattern"], int(whole), int(rest)))
    # Rows that repeat an id come together: their hash counts all their words.
    sums = cut(slim.groupBy("__pattern", "__hash").agg(F.sum("__size").alias("__words"), F.count(F.lit(1)).alias("n")))
    repeated = sums.where("n > 1")
    return Mix(_choose(sums, rules), slim, None if repeated.isEmpty() else repeated, dict(zip(names, sizes, strict=True)), quotas, seed)


def _overlapping_targets(total: int, sizes: list[int], scale: list[float]) -> list[float]:
    """As ``targets`` where sources overlap: what is shared out is the words of all documents, each once."""
    factor = sum(sizes) / total if total else 1.0
    return [t / factor for t in targets(sizes, scale)]


def _choose(sums: DataFrame, rules: list[tuple[str, int, int]]) -> DataFrame:
    """Per pattern, how often all is taken, and the runs of hashes that are taken once more.

    A round takes documents of at most the words still wanted in the order of hashes, up to the first that is too
    long for what is then left; the next round goes on behind. Each takes a document at least, so they end.
    """
    spark = sums.sparkSession
    part = F.substring("__hash", 1, HEX_DIGITS)
    runs = {key: [] for key, _, _ in rules}
    open_ = {key: ("", rest) for key, _, rest in rules if rest}
    while open_:
        wanted = spark.createDataFrame([(k, after, gap) for k, (after, gap) in open_.items()], "__pattern string, __after string, __gap long")
        free = sums.join(F.broadcast(wanted), "__pattern").where((F.col("__hash") > F.col("__after")) & F.col("__words").between(1, F.col("__gap"))).withColumn("__part", part)
        parts = free.groupBy("__pattern", "__gap", "__part").agg(F.sum("__words").alias("words"))
        through = Window.partitionBy("__pattern").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = parts.withColumn("through", F.sum("words").over(through))
        # The part of each pattern where the words run out, if they do: one row a pattern.
        crossed = F.min(F.when(F.col("through") > F.col("__gap"), F.struct("__part", (F.col("through") - F.col("words")).alias("before"))))
        crossing = running.groupBy("__pattern").agg(F.sum("words").alias("total"), crossed.alias("at")).select("__pattern", "total", "at.__part", "at.before")
        inside = free.join(F.broadcast(crossing), ["__pattern", "__part"])
        peers = Window.partitionBy("__pattern").orderBy("__hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = inside.withColumn("taken", F.col("before") + F.sum("__words").over(peers)).where("taken <= __gap")
        ends = reached.groupBy("__pattern").agg(F.max("__hash").alias("last"), F.max("taken").alias("taken"))
        found = {r["__pattern"]: r for r in crossing.join(ends, "__pattern", "left").collect()}
        for key, (after, gap) in list(open_.items()):
            r = found.get(key)
            if r is None or r["__part"] is None:
                # All that fit are taken, if any do.
                if r is not None:
                    runs[key].append((after, LAST_HASH, gap))
                del open_[key]
                continue
            # No hash starts like a part and orders before it, so the part itself bounds the ones below.
            last, taken = (r["last"], r["taken"]) if r["last"] else (r["__part"], r["before"])
            runs[key].append((after, last, gap))
            open_[key] = (last, gap - int(taken))
            if open_[key][1] == 0:
                del open_[key]
    return spark.createDataFrame([(key, whole, runs[key]) for key, whole, _ in rules], "__pattern string, __all int, __runs array<struct<after string, upto string, most long>>")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Per document: size, its source's size and target, words taken, copies."""
    members = F.array(F.col(source_col).cast("string"))
    decided = plan(docs, id_col, text_col, members, seed=seed)
    spark = docs.sparkSession
    sources = spark.createDataFrame([(s, int(decided.words[s]), float(t)) for s, t in decided.quotas.items()], "source string, source_size long, target double")
    taken = decided.apply(decided.slim.select("__id", "__members", "__size"), "__id", F.col("__members"), size=F.col("__size"))
    own = taken.withColumn("__source", F.col("__members")[0]).join(F.broadcast(sources), F.col("__source").eqNullSafe(F.col("source")))
    return own.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), F.col("__copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    members = F.array(F.col(source_col).cast("string"))
    decided = plan(docs, id_col, text_col, members, seed=seed)
    # The rows as one column, so that no name of theirs meets one of the mix.
    places = [f"c{i}" for i in range(len(docs.columns))]
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, places, strict=True)]).alias("row"), F.col(id_col).alias("id"), members.alias("members"), word_count(F.col(text_col)).alias("size"))
    taken = decided.apply(packed, "id", F.col("members"), size=F.col("size"))
    return taken.where("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"row.{p}").alias(c) for c, p in zip(docs.columns, places, strict=True)])
