"""Budgeted context packs: excerpts, budget prefix, greedy section dedup, headroom relaxation, pointer index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import DEFAULT
from loomgraph.functions.exprs import excerpt, token_estimate


def sections(results: DataFrame, entities: DataFrame) -> DataFrame:
    """Ranked results (query_id, id, rank) with title, content, cost; code content is summarised: modules to 1 line, files to 15,
    others to 10."""
    text = F.col("content")
    short = F.when(F.col("type") == "module", excerpt(text, 1)).when(F.col("type") == "file", excerpt(text, 15)).when(F.col("type").isin("function", "class"), excerpt(text, 10)).otherwise(text)
    joined = results.join(entities.select("id", "type", "title", "content"), "id")
    return joined.withColumn("content", short).withColumn("cost", token_estimate(F.coalesce("title", F.lit(""))) + token_estimate(F.col("content")))


def compressed_tail(rows: DataFrame, cfg=DEFAULT) -> DataFrame:
    """Sections past the tail rank keep 1, 8, 4 or 8 lines by type."""
    text = F.col("content")
    short = F.when(F.col("type") == "module", excerpt(text, 1)).when(F.col("type").isin("function", "class"), excerpt(text, 4)).otherwise(excerpt(text, 8))
    content = F.when(F.col("rank") > cfg.tail_rank, short).otherwise(text)
    return rows.withColumn("content", content).withColumn("cost", token_estimate(F.coalesce("title", F.lit(""))) + token_estimate(F.col("content")))


def budget_fit(rows: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Rows (keys, id, rank, cost) within a budget by rank: used_before < budget; the row across the edge is cut to the rest. Once
    the budget is used up, only rows without cost still fit."""
    order = Window.partitionBy(*keys).orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("cost").over(order)
    before = total - F.col("cost")
    sized = rows.withColumn("_total", total).withColumn("_before", before).where((F.col("_before") < budget) | (F.col("cost") == 0))
    kept = F.when(F.col("_total") <= budget, F.col("cost")).when(F.col("cost") == 0, F.lit(0)).otherwise(budget - F.col("_before"))
    return sized.withColumn("kept_cost", kept.cast("long")).withColumn("truncated", F.col("kept_cost") < F.col("cost")).drop("_total", "_before")


def truncated(text, tokens):
    """A text cut to some tokens, with a mark."""
    return F.when(F.length(text) <= tokens * 4, text).otherwise(F.concat(F.left(text, F.greatest(tokens * 4 - 3, F.lit(0)).cast("int")), F.lit("...")))


def pointer_index(rows: DataFrame, packed: DataFrame, budget: int, keys: list[str], lines: int = 25) -> DataFrame:
    """Titles of what did not fit, within what is left of the budget."""
    used = packed.groupBy(*keys).agg(F.sum("kept_cost").alias("used"))
    out = rows.join(packed.select(*keys, "id"), [*keys, "id"], "left_anti").join(used, keys, "left")
    out = out.withColumn("line", F.concat(F.lit("- "), F.coalesce("title", "id"))).withColumn("line_cost", token_estimate(F.col("line")) + 1)
    order = Window.partitionBy(*keys).orderBy("rank", "id")
    out = out.withColumn("_n", F.row_number().over(order)).withColumn("_sum", F.sum("line_cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("_n") <= lines) & (F.col("_sum") <= budget - F.coalesce("used", F.lit(0)))).select(*keys, "id", "line", F.col("_n").alias("pointer_rank"))


def _lines(text: str) -> frozenset:
    return frozenset(s for s in (x.strip() for x in (text or "").split("\n")) if len(s) > 3)


def dedup_sections(rows: DataFrame, least: float = DEFAULT.section_jaccard, most: int = 2000) -> DataFrame:
    """Drops sections (query_id, id, rank, content) whose line set is like that of a kept earlier one. Greedy, so one bounded
    group per query; longer lists are refused."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError(f"{len(group)} sections in a pack; cut to {most} first")
        kept, keep = [], []
        for r in group.sort_values(["rank", "id"]).itertuples():
            mine = _lines(r.content)
            if not any(mine and k and len(mine & k) / len(mine | k) >= least for k in kept):
                kept.append(mine)
                keep.append((r.query_id, r.id, r.rank))
        return pd.DataFrame(keep, columns=["query_id", "id", "rank"])

    return rows.select("query_id", "id", "rank", "content").groupBy("query_id").applyInPandas(one, "query_id long, id string, rank int")


def relaxed(packed: DataFrame, budget: int, cap: int = 400, most: int = 2000) -> DataFrame:
    """Headroom goes back to compressed sections (query_id, id, rank, kept_cost, full_cost) by rank: first up to a cap each, then in
    full. Sequential in the budget left, so one bounded group per query."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError("too many sections in a pack")
        group = group.sort_values(["rank", "id"])
        cost, left = group["kept_cost"].tolist(), budget - int(group["kept_cost"].sum())
        for limit in (cap, None):
            for i, full in enumerate(group["full_cost"]):
                want = min(full, limit) if limit is not None else full
                if want > cost[i] and want - cost[i] <= left:
                    left -= want - cost[i]
                    cost[i] = want
        return pd.DataFrame({"query_id": group["query_id"], "id": group["id"], "rank": group["rank"], "relaxed_cost": cost})

    return packed.select("query_id", "id", "rank", "kept_cost", "full_cost").groupBy("query_id").applyInPandas(one, "query_id long, id string, rank int, relaxed_cost long")


def code_map(entities: DataFrame, files: int = 15, pool: int = 50) -> DataFrame:
    """(file_path, symbols): the files with the most symbols; tests are dropped after the pool is cut."""
    from loomgraph.functions.exprs import is_test_path

    rich = entities.where(F.col("type").isin("function", "class") & (F.col("status") == "active")).groupBy("file_path").agg(F.count("*").alias("symbols"))
    return rich.orderBy(F.desc("symbols"), "file_path").limit(pool).where(~is_test_path(F.col("file_path"))).orderBy(F.desc("symbols"), "file_path").limit(files)
