"""Hybrid search for batches of queries: lexical, vector, feedback and graph channels, fused and re-ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import CODE_TYPES, DEFAULT
from loomgraph.operators import fusion, graph, lexical, vector
from loomgraph.session import Scratch


@dataclass
class Corpus:
    """Tables of a search: entities, edges; vectors (id, embedding) and drift (entity_id) may be missing."""

    entities: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    drift: DataFrame | None = None


def lexical_hits(corpus: Corpus, queries: DataFrame, k: int, cfg=DEFAULT):
    """First-pass hits, with what later steps reuse: df of the terms, the terms, corpus size. Hits are a few rows per query and
    feed several later steps, so they are written once."""
    terms = lexical.query_terms(queries)
    index = lexical.Index(corpus.entities, terms, cfg)
    return Scratch(corpus.entities.sparkSession, "hits").write(index.best(k), "hits"), index.df, terms, index.n


def search_many(corpus: Corpus, queries: DataFrame, limit: int = DEFAULT.max_results, cfg=DEFAULT) -> DataFrame:
    """(query_id, id, channel, score, rank) of queries (query_id, text[, q]): q is a query vector.

    All queries share one plan. Channels become ranked lists, lists are fused by reciprocal rank within code and knowledge,
    normalised, weighted by the channels' evidence, cut at the relevance floor, demoted for drift, lifted by curated
    references and cut to the limit.
    """
    wide = 3 * limit
    hits, _, terms, _ = lexical_hits(corpus, queries, wide, cfg)
    more = lexical.expanded_hits(corpus.entities, hits.where(F.col("rank") <= limit), terms, wide, cfg)
    lists = [hits.select("query_id", "id", "rank", F.lit(cfg.fts_weight).alias("weight"), F.lit("fts").alias("list"))]
    again = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    lists.append(more.select("query_id", "id", F.row_number().over(again).alias("rank"), F.lit(0.3 * cfg.fts_weight).alias("weight"), F.lit("feedback").alias("list")))
    if corpus.vectors is not None and "q" in queries.columns:
        pool = corpus.vectors.select(F.lit(0).alias("g"), "id", F.col("embedding").alias("e"))
        asked = queries.where(F.col("q").isNotNull()).select(F.lit(0).alias("g"), F.col("query_id").alias("id"), F.col("q").alias("e"))
        near = vector.nearest(asked, pool, wide).select(F.col("id").alias("query_id"), F.col("other").alias("id"), "distance")
        order = Window.partitionBy("query_id").orderBy(F.round("distance", 9).asc_nulls_last(), "id")
        knn = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wide)
        lists.append(knn.select("query_id", "id", "rank", F.lit(cfg.vec_weight).alias("weight"), F.lit("vector").alias("list")))
    else:
        knn = None
    ranked = lists[0]
    for other in lists[1:]:
        ranked = ranked.unionByName(other)
    # few rows a query: written, so that the tables they meet stay where they are
    scratch = Scratch(corpus.entities.sparkSession, "search")
    ranked = scratch.write(ranked, "ranked")
    seeds = graph.seed_weights(ranked.where("list <> 'feedback'").select("query_id", "id", "rank"), cfg)
    seeds = scratch.write(seeds, "seeds")
    both = graph.undirected(corpus.edges.where(F.col("edge_type").isin("references", "supports", "contradicts", "superseded_by", "derived_from", "promoted_from")))
    around = seeds.join(both, F.col("id") == F.col("node")).groupBy("query_id", F.col("neighbor").alias("id")).agg((F.sum("weight") * cfg.hop_decay).alias("score")).where(F.col("score") >= cfg.graph_floor)
    linked = around.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= wide)
    ranked = ranked.unionByName(linked.select("query_id", "id", "rank", F.lit(cfg.graph_weight).alias("weight"), F.lit("graph").alias("list")))
    kinds = corpus.entities.select("id", F.when(F.col("type").isin(*CODE_TYPES), "code").otherwise("knowledge").alias("channel"))
    scores = scratch.write(fusion.rrf(ranked, ["query_id"], cfg.rrf_k), "scores")
    ids = scores.select("id").distinct()
    fused = scores.join(kinds, "id")
    pool_sizes = hits.join(kinds, "id").groupBy("query_id").agg(F.count_if(F.col("channel") == "code").alias("code_hits"), F.count_if(F.col("channel") == "knowledge").alias("knowledge_hits"))
    code = F.greatest(F.lit(cfg.min_source_proportion), F.least(fusion.pool_share(), F.lit(1 - cfg.min_source_proportion)))
    shares = pool_sizes.withColumn("code", code)
    weights = shares.select("query_id", F.explode(F.create_map(F.lit("code"), F.col("code"), F.lit("knowledge"), 1 - F.col("code"))).alias("channel", "weight"))
    merged = fusion.merge_channels(fused, weights, ["query_id"], cfg.min_relevance)
    if corpus.drift is not None:
        merged = fusion.demote_drifted(merged, corpus.drift, cfg.drift_penalty).drop("drift_count")
    lifted = fusion.provenance_prior(merged, corpus.edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"), cfg.provenance_boost)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    top = lifted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (wide if knn is not None else limit))
    if knn is None:
        return top.select("query_id", "id", "channel", "score", "rank")
    share = shares.select("query_id", F.col("code").alias("_c"))
    diverse = top.join(share, "query_id").withColumn("share", F.when(F.col("channel") == "code", F.col("_c")).otherwise(1 - F.col("_c"))).join(corpus.vectors.join(ids, "id", "left_semi").select("id", F.col("embedding").cast("array<double>").alias("embedding")), "id", "left")
    return fusion.rerank(diverse.select("query_id", "id", "channel", "score", "share", "embedding"), limit, cfg)



def ground_truth_scores(results: DataFrame, truth: DataFrame, k: int = 5, wide: int = 20) -> DataFrame:
    """Per query of (query_id, id, rank) against (query_id, expected ids): precision at k, reciprocal rank, recall at `wide`."""
    wanted = truth.select("query_id", F.explode("expected").alias("id")).distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    hit = results.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("top"), F.min("rank").alias("first"), F.count_if(F.col("rank") <= wide).alias("found"))
    scored = size.join(hit, "query_id", "left")
    return scored.select("query_id", (F.coalesce("top", F.lit(0)) / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"))
