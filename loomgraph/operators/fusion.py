"""Fusion and ranking: reciprocal ranks, channel weights, drift, provenance, diversity."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import CURATED, DEFAULT
from loomgraph.functions.exprs import l2_to_cosine


def rrf(lists: DataFrame, keys: Iterable[str] = (), k: int = DEFAULT.rrf_k) -> DataFrame:
    """Sum of weight / (k + rank) per id over ranked lists (keys..., id, rank, weight)."""
    return lists.groupBy(*keys, "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def max_normalised(scores: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Scores divided by their group's maximum, if that is positive."""
    top = F.max("score").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return scores.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def merge_channels(channels: DataFrame, weights: DataFrame, keys: list[str], floor: float = DEFAULT.min_relevance) -> DataFrame:
    """Normalised channel lists (keys, channel, id, score) times their weights, above the floor."""
    normal = max_normalised(channels, [*keys, "channel"])
    return normal.join(weights, [*keys, "channel"]).withColumn("score", F.col("score") * F.col("weight")).where(F.col("score") >= floor).drop("weight")


def channel_signals(knn: DataFrame, keys: list[str]) -> DataFrame:
    """Per channel of distances (keys, channel, distance): strength (mean cosine of the top 3) and gradient (top 5)."""
    order = Window.partitionBy(*keys, "channel").orderBy(F.col("distance").asc_nulls_last(), "id")
    ranked = knn.withColumn("r", F.row_number().over(order)).where("r <= 5")
    widest = ranked.withColumn("dmax", F.max("distance").over(Window.partitionBy(*keys, "channel")))
    slope = F.when(F.col("dmax") > 0, 1 - F.col("distance") / F.col("dmax")).otherwise(1.0)
    cos = F.least(F.greatest(l2_to_cosine(F.col("distance")), F.lit(0.0)), F.lit(1.0))
    return widest.groupBy(*keys, "channel").agg(F.avg(F.when(F.col("r") <= 3, cos)).alias("strength"), F.avg(slope).alias("gradient"))


def pool_share(code: str = "code_hits", knowledge: str = "knowledge_hits"):
    """Damped share of code among lexical hits; a half when there are none."""
    a, b = F.sqrt(F.col(code).cast("double")), F.sqrt(F.col(knowledge).cast("double"))
    return F.when(a + b > 0, a / (a + b)).otherwise(0.5)


def detect_weights(signals: DataFrame, floor: float = DEFAULT.min_source_proportion) -> DataFrame:
    """code and knowledge weights from gradients (code_gradient, knowledge_gradient) and lexical hits, kept above a floor."""
    total = F.col("code_gradient") + F.col("knowledge_gradient")
    from_knn = F.when(total > 0, F.col("code_gradient") / total).otherwise(0.5)
    share = F.coalesce((from_knn + pool_share()) / 2, pool_share())
    code = F.least(F.greatest(share, F.lit(floor)), F.lit(1 - floor))
    return signals.withColumn("code_weight", code).withColumn("knowledge_weight", 1 - code)


def demote_drifted(scores: DataFrame, drift: DataFrame, penalty: float = DEFAULT.drift_penalty) -> DataFrame:
    """Scores times penalty ^ (drift rows of the entity)."""
    counts = drift.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("drift_count"))
    n = F.coalesce("drift_count", F.lit(0))
    return scores.join(counts, "id", "left").withColumn("drift_count", n).withColumn("score", F.col("score") * F.pow(F.lit(penalty), F.col("drift_count")))


def curated_in_degree(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*CURATED)).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))


def provenance_prior(scores: DataFrame, edges: DataFrame, boost: float = DEFAULT.provenance_boost) -> DataFrame:
    """Scores times 1 + boost * ln(1 + curated in-degree)."""
    joined = scores.join(curated_in_degree(edges), "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return joined.withColumn("score", F.col("score") * (1 + boost * F.log1p("in_degree")))


def corroborated(deep: DataFrame, keys: list[str]) -> DataFrame:
    """Ids below the direct window that two channels have."""
    return deep.groupBy(*keys, "id").agg(F.countDistinct("channel").alias("channels")).where("channels >= 2")


def mmr_order(scores: np.ndarray, vectors: list, channel: list, lam: float) -> list[int]:
    """Greedy order by lam * score - (1 - lam) * greatest cosine to a chosen one of the same channel."""
    unit = []
    for v in vectors:
        x = None if v is None else np.asarray(v, np.float64)
        n = 0.0 if x is None else float(np.linalg.norm(x))
        unit.append(x / n if n > 0 else None)
    left, chosen = list(range(len(scores))), []
    penalty = np.zeros(len(scores))
    while left:
        best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * penalty[i], -i))
        left.remove(best)
        chosen.append(best)
        for i in left:
            if channel[i] == channel[best] and unit[i] is not None and unit[best] is not None and len(unit[i]) == len(unit[best]):
                penalty[i] = max(penalty[i], float(unit[i] @ unit[best]))
    return chosen


def diversity_slot(order: list[int], channel: list, share: dict, window: int = 5, least: float = DEFAULT.top_diversity_share) -> list[int]:
    """The best of each sufficiently strong channel is moved into the window if it is not there."""
    order = list(order)
    for name in sorted(share):
        if share[name] >= least and not any(channel[i] == name for i in order[:window]):
            at = next((p for p, i in enumerate(order) if channel[i] == name), None)
            if at is not None:
                order.insert(window - 1, order.pop(at))
    return order


def window_quota(order: list[int], channel: list, share: dict, limit: int) -> list[int]:
    """At least floor(share * limit) of each channel within the first `limit`, taking the places of the last others."""
    head, tail = list(order[:limit]), list(order[limit:])
    for name in sorted(share):
        need = int(share[name] * limit)
        while sum(channel[i] == name for i in head) < need:
            at = next((p for p, i in enumerate(tail) if channel[i] == name), None)
            spare = [p for p in range(len(head) - 1, -1, -1) if channel[head[p]] != name and sum(channel[i] == channel[head[p]] for i in head) > int(share.get(channel[head[p]], 0) * limit)]
            if at is None or not spare:
                break
            out = head.pop(spare[0])
            head.append(tail.pop(at))
            tail.insert(0, out)
    return head + tail


def rerank(candidates: DataFrame, limit: int, cfg=DEFAULT, most: int = 1000) -> DataFrame:
    """Diversity within each query: candidates (query_id, id, channel, score, share, embedding) get their final rank.

    The order is sequential by nature, so each query is one group of bounded size; larger ones are refused.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"{len(rows)} candidates in a query; cut to {most} before ranking")
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        channel = rows["channel"].tolist()
        share = dict(zip(rows["channel"], rows["share"]))
        order = mmr_order(rows["score"].to_numpy(), rows["embedding"].tolist(), channel, cfg.mmr_lambda)
        order = window_quota(diversity_slot(order, channel, share, least=cfg.top_diversity_share), channel, share, limit)
        out = rows.iloc[order][["query_id", "id", "channel", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out[out["rank"] <= limit]

    return candidates.groupBy("query_id").applyInPandas(one, "query_id long, id string, channel string, score double, rank int")


def capped_expansion(expansion: DataFrame, limit: int) -> DataFrame:
    """At most limit / 4 co-change results after the best others, `limit` in all; expansion: query_id, id, kind, score."""
    best = Window.partitionBy("query_id", F.col("kind") == "cochange").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = expansion.withColumn("r", F.row_number().over(best))
    kept = ranked.where((F.col("kind") != "cochange") | (F.col("r") <= limit // 4))
    late = Window.partitionBy("query_id").orderBy((F.col("kind") == "cochange").cast("int"), F.desc(F.round("score", 9)), "id")
    n_co = F.sum((F.col("kind") == "cochange").cast("int")).over(Window.partitionBy("query_id"))
    sized = kept.withColumn("n_co", n_co).where((F.col("kind") == "cochange") | (F.col("r") <= limit - F.col("n_co")))
    return sized.withColumn("rank", F.row_number().over(late)).select("query_id", "id", "kind", "score", "rank")


def first_emitter(emitted: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One row per query and id: that of the emitter of the least priority number, then the best score."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in priority.items()))
    order = Window.partitionBy("query_id", "id").orderBy(rank, F.desc("score"))
    return emitted.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
