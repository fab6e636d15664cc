"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.token_binary import token_binary

    return token_binary(spark, table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.pii import find_spans

    return find_spans(spark, table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.packing import pack_documents

    return pack_documents(spark, table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.topk import quantised, top_k

    return top_k(spark, quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.neardup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.substring import repeated_passages

    return repeated_passages(spark, table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.audio import media_features

    return media_features(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_binary": op1_token_binary,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_packing": op5_packing,
    "op6_topk": op6_topk,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_audio": op10_audio,
    "pipeline": pipeline,
}

ORACLES = {
    "op6_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
}
