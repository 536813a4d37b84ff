"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

quality     documents that the attention classifier scores below one half go
lines       pairs of lines that repeat anywhere stay only where they occur first
near_copies one document of each class of near copies stays, that of the least id
mix         documents are taken as often as the mix of sources to target weights takes them
tokens      every text left as byte-level BPE ids, with a digest of the text decoded from them

The tokenizer's vocabulary is the public rank file named by VOCAB. SQL can express neither the first
stage's model nor the last one's merges, so there is no SQL for run(); tests/llm has brute-force versions.

Null texts are scored like empty ones, stay null until the last stage and encode as no ids there; a null and
an empty text are near copies of each other. Texts are read whole in every stage, however long. Of ties
the lesser id, then text hash goes first; null ids go last. Rows that repeat an id are documents of
their own, but for the mix, which takes all of them or none. Empty tables give empty results. Columns beside doc_id, text and source
pass through all stages, whatever their names; only text is left out by the last, ``n_chars`` is counted anew where
there is one, and a column named like one that the last stage adds gives way to it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import bpe, jaccard, linededup, mil, mixing
from vellumine.llm.store import bound_batches, fresh_path

VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil.keep_good(docs, bound_batches(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return jaccard.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    added = ("n_tokens", "ids", "decoded", "decoded_sha256")
    keep = tuple(c for c in docs.columns if c != "text" and c not in added)
    both = bpe.encode(docs, vocab_path=VOCAB, pattern=public_tokenizers.PATTERN, keep=keep, decoded_col="decoded")
    return both.select(*[F.col(f"`{c}`") for c in keep], F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
