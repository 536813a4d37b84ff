"""Removal of repeated runs of lines, by chunks whose ends the content itself defines.

A rolling hash runs over the hashes of a text's lines, two lines at a time, blank ones left out. A chunk
ends between two lines wherever their rolling hash occurs once in all texts, for such a pair is in no
repeated passage; so an end depends on two lines only, and a passage that moves keeps its inner ends,
however short it is. Within a chunk every pair of neighbouring lines is compared, byte for byte and with
the blank lines between, with all others of its hash. A pair that stands earlier as well, in a lesser
document id, then text hash, then place, is removed with the blank lines between. What is removed thus always
stays where it came first, line by line; single lines are never removed on their own.

Pairs meet by a 64-bit hash and then by their bytes; hash values that hold much of the table are joined
by broadcast, of which there can be a few hundred at most. Only pairs of a repeated hash have their text
sent about. All of it is DataFrame expressions.

Null texts stay null, empty ones empty; a text of which all is removed becomes empty. Null ids order
last. Rows that repeat id and text count as one document at one place: each keeps what the first keeps.
Other columns pass through unchanged, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.store import cut, lookup_join

LAST_ID = (1 << 63) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it and the plan is rewritten."""
    return F.get(F.transform(F.array(value), body), 0)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _written(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())


def rolling(text: Column) -> Column:
    """The rolling hash of each pair of neighbouring lines that are not blank: by turns to the left, as texts pass."""
    turned = lambda h: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
    hashes = F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: turned(x).bitwiseXOR(F.get(h, i + 1))))


def pairs(text: Column, places: Column) -> Column:
    """(i, t) of the pairs of lines at ``places``: from one line that is not blank to the next."""

    def cut_out(lines: Column, at: Column) -> Column:
        span = lambda i: F.slice(lines, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i) + 1)
        return F.transform(places, lambda i: F.struct(i.alias("i"), F.array_join(span(i), "\n").alias("t")))

    return let(_lines(text), lambda lines: let(_written(lines), lambda at: cut_out(lines, at)))


def without(text: Column, gone: Column) -> Column:
    """(text, n): the text without the pairs at ``gone`` (in rising order), and how many lines went."""
    # Whether a pair goes, by place: what stands between two that go is false.
    flags = F.flatten(F.transform(gone, lambda g, k: F.concat(F.array_repeat(F.lit(False), g - F.coalesce(F.get(gone, k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))

    def left(lines: Column, at: Column, flag: Column) -> Column:
        goes = lambda i: F.coalesce(F.get(flag, i), F.lit(False))
        until = lambda i: F.coalesce(F.get(at, i + 1), F.size(lines))
        none = F.slice(lines, 1, 0)
        line = lambda p, i: F.when(goes(i) | goes(i - 1), none).otherwise(F.slice(lines, p + 1, 1))
        blank = lambda p, i: F.when(goes(i), none).otherwise(F.slice(lines, p + 2, until(i) - p - 1))
        head = F.slice(lines, 1, F.get(at, 0))
        kept = F.concat(head, F.flatten(F.transform(at, lambda p, i: F.concat(line(p, i), blank(p, i)))))
        return let(kept, lambda rest: F.struct(F.array_join(rest, "\n").alias("text"), (F.size(lines) - F.size(rest)).cast("long").alias("n")))

    return let(flags, lambda flag: let(_lines(text), lambda lines: let(_written(lines), lambda at: left(lines, at, flag))))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated pairs of lines taken out of the text; ``removed_col`` adds how many lines went."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    id_, text = (columns[docs.columns.index(c)] for c in (id_col, text_col))
    key = F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit("null"))
    # The same columns are wanted of the texts below as in the end, so that one shuffle of theirs serves both.
    rows = rows.withColumns({"k": key, "th": F.xxhash64(text)})
    order = F.coalesce(F.expr(f"try_cast({id_} AS bigint)"), F.lit(LAST_ID))
    hashed = rows.select("k", "th", F.posexplode(rolling(F.col(text))).alias("i", "hash"))
    repeated = cut(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = lookup_join(hashed, repeated.select("hash", "n"), ["hash"], "n", total, F.xxhash64("k", "i"), how="inner")
    inside = cut(found.groupBy("k", "th").agg(F.array_sort(F.collect_set("i")).alias("places")))
    texts = rows.join(inside, ["k", "th"]).select("k", "th", order.alias("ord"), F.explode(pairs(F.col(text), F.col("places"))).alias("p"))
    firsts = texts.groupBy("p.t").agg(F.min(F.struct("ord", "k", "th", "p.i")).alias("first")).select("first.k", "first.th", "first.i")
    stays = firsts.groupBy("k", "th").agg(F.collect_set("i").alias("stays"))
    gone = inside.join(stays, ["k", "th"], "left").select("k", "th", F.array_sort(F.array_except("places", F.coalesce("stays", F.array().cast("array<int>")))).alias("gone")).where(F.size("gone") > 0)
    joined = rows.join(gone, ["k", "th"], "left")
    result = joined.withColumn("left", F.when(F.col("gone").isNotNull(), without(F.col(text), F.col("gone"))))
    taken = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.col("left.text"))
    out = [(taken if c == text else F.col(c)).alias(name) for c, name in zip(columns, docs.columns, strict=True)]
    if removed_col:
        out.append(F.coalesce("left.n", F.lit(0).cast("long")).alias(removed_col))
    return result.select(*out)
