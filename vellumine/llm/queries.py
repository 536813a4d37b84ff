"""Queries of this subpackage, one per operator, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import bpe, jaccard, linededup, mil, mixing, sharding, tiff, topk, unigram, warc
from vellumine.llm.store import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(_table(spark, sf_dir, "documents"))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * 24)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counts(_table(spark, sf_dir, "documents"), unigram.load_sentencepiece(public_tokenizers.path("piece_bpe_32k.model")))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="n_removed")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocab_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiff_pages": op1_tiff_pages,
    "op2_rendezvous_shards": op2_rendezvous_shards,
    "op3_exact_topk": op3_exact_topk,
    "op4_attention_quality": op4_attention_quality,
    "op5_unigram_counts": op5_unigram_counts,
    "op6_warc_archive": op6_warc_archive,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_line_chunks": op8_line_chunks,
    "op9_mix_sources": op9_mix_sources,
    "op10_byte_bpe": op10_byte_bpe,
}

LINE_CHUNKS_SQL = """
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
    w AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE trim(line, ' ') <> ''),
    p AS (SELECT doc_id, i, j, array_to_string(ls[i + 1 : j + 1], chr(10)) AS t FROM w JOIN s USING (doc_id) WHERE j IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS gone FROM p),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i, true AS goes FROM f WHERE gone),
    r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE goes IS NULL) AS text, count(goes) AS n_removed FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
    SELECT {columns} FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
    "op8_line_chunks": LINE_CHUNKS_SQL.format(columns="d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(r.n_removed, 0) AS n_removed"),
}
