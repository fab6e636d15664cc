"""Filtered reads and counts over entities, drift rows and the usage log. `properties` is a JSON object in a string column;
malformed or null JSON counts as having no properties. Limits are given by the caller, None for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import exprs
from loomgraph.functions.constants import RECORD_CATEGORIES

MEMORY = ("observation", "rule", "knowledge")
DECAY = 0.3  # of an expansion's score with each hop


def _property(name: str) -> Column:
    return F.get_json_object("properties", f"$.{name}")


def _cut(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def rules_by_confidence(entities: DataFrame, status: str | None = "active", limit: int | None = None) -> DataFrame:
    """Rules by confidence (1.0 where none is given), then the latest, then id."""
    rules = entities.where("type = 'rule'") if status is None else entities.where((F.col("type") == "rule") & (F.col("status") == status))
    ranked = rules.withColumn("confidence", F.coalesce(_property("confidence").try_cast("double"), F.lit(1.0)))
    return _cut(ranked.orderBy(F.desc("confidence"), F.desc("updated_at"), "id"), limit)


def knowledge_filtered(entities: DataFrame, status: str | None = None, category: str | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Knowledge of a category that has any of the tags, the latest first."""
    found = entities.where("type = 'knowledge'")
    if status is not None:
        found = found.where(F.col("status") == status)
    if category is not None:
        found = found.where(_property("category") == category)
    if tags:
        found = found.where(F.arrays_overlap(F.from_json(_property("tags"), "array<string>"), F.array(*map(F.lit, tags))))
    return _cut(found.orderBy(F.desc("updated_at"), "id"), limit)


def living(entities: DataFrame) -> DataFrame:
    """Entities that drift can touch: no observations, no records."""
    dated = (F.coalesce(_property("volatility"), F.lit("")) == "record") | F.coalesce(_property("category"), F.lit("")).isin(*RECORD_CATEGORIES)
    return entities.where((F.col("type") != "observation") & ~dated)


def to_verify(entities: DataFrame, drift: DataFrame, selection: str) -> DataFrame:
    """(id, title) of the entities a verification pass takes: drifted, stale, unverified or all. drift: (entity_id, code_id, cause)."""
    if selection == "drifted":
        rows = drift.select(F.col("entity_id").alias("id")).distinct().join(entities.select("id", "title"), "id", "left")
        return rows.select("id", F.coalesce("title", F.lit("")).alias("title"))
    backed = entities.where(F.col("file_path").isNotNull() & F.col("type").isin(*MEMORY))
    if selection == "stale":
        rows = backed.where("status = 'stale'")
    elif selection in ("unverified", "all"):
        rows = living(backed).where("status in ('active', 'stale')")
        if selection == "unverified":
            marked = drift.where("cause = 'unverified'").select(F.col("entity_id").alias("id")).distinct()
            never = F.coalesce(_property("verified_against"), F.lit("[]")) == "[]"
            rows = rows.join(marked.withColumn("marked", F.lit(True)), "id", "left").where(never | F.col("marked"))
    else:
        raise ValueError(f"unknown selection: {selection}")
    return rows.select("id", F.coalesce("title", F.lit("")).alias("title"))


def drifted_on(entities: DataFrame, drift: DataFrame, code_ids: DataFrame) -> DataFrame:
    """(id, title) of the entities that drifted because of the given code."""
    hit = drift.join(code_ids.select(F.col("id").alias("code_id")), "code_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    return entities.join(hit, "id", "left_semi").select("id", "title")


def corpus_counts(entities: DataFrame, drift: DataFrame) -> DataFrame:
    """One row: curated (active rules and knowledge), young (fewer than ten of them), drifted and stale entities."""
    counts = entities.agg(
        F.count_if((F.col("status") == "active") & F.col("type").isin("rule", "knowledge")).alias("curated"),
        F.count_if((F.col("status") == "stale") & F.col("type").isin(*MEMORY)).alias("stale"),
    )
    drifted = drift.agg(F.count_distinct("entity_id").alias("drifted"))
    return counts.withColumn("one", F.lit(1)).join(drifted.withColumn("one", F.lit(1)), "one").select("curated", (F.col("curated") < 10).alias("young"), "drifted", "stale")


def events_of(log: DataFrame, entity_ids: DataFrame | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Log rows of some entities and of a kind, the latest first."""
    rows = log if entity_ids is None else log.join(entity_ids.select(F.col("id").alias("key")), "key", "left_semi")
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return _cut(rows.orderBy(F.desc("ts"), F.desc("id")), limit)


def with_file(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members with file_id: the least id of the files at their path, null where there is none."""
    one = files.where("type = 'file'").groupBy("file_path").agg(F.min("id").alias("file_id"))
    return members.join(one, "file_path", "left")


def contains_edges(entities: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): every file contains the functions and classes at its path."""
    members = entities.where("type in ('function', 'class')").select("id", "file_path")
    return with_file(members, entities).where("file_id is not null").select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("edge_type"))


def section_order(mode: str) -> list[Column]:
    """Sort keys of context sections (source, relevance, entity_id): what was asked for first, or the compact kinds first."""
    kinds = {"identity": 0, "rule": 1, "knowledge": 2, "function": 3, "class": 3, "file": 3, "module": 3, "observation": 4}
    place = F.coalesce(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("source")], F.lit(5))
    relevance = F.desc("relevance")
    if mode not in ("task", "escalation", "cold_start"):
        raise ValueError(f"unknown mode: {mode}")
    return [place, relevance, F.col("entity_id")] if mode == "cold_start" else [relevance, place, F.col("entity_id")]


def decayed(paths: DataFrame, seeds: DataFrame, floor: float = 0.0, weighted: bool = True) -> DataFrame:
    """(id, seed, relevance) of expansion paths (id, seed, depth, edge_path): the seed's relevance, less with each hop, times the
    weights of the edge types. seeds: (id, relevance); a seed without one has none."""
    share = F.aggregate(F.transform("edge_path", exprs.edge_weight), F.lit(1.0), lambda a, w: a * w) if weighted else F.lit(1.0)
    of_seed = seeds.select(F.col("id").alias("seed"), F.col("relevance").alias("seed_relevance"))
    scored = paths.join(of_seed, "seed", "left").withColumn("relevance", F.coalesce("seed_relevance", F.lit(0.0)) * F.pow(F.lit(DECAY), F.col("depth")) * share)
    return scored.where(F.col("relevance") >= floor).select("id", "seed", "relevance")


def edited_observations(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file_path) of observations whose file (file_path, content) no longer has the recorded hash."""
    own = entities.where("type = 'observation' and content_hash is not null").select("id", "file_path", "content_hash")
    return own.join(files.select("file_path", F.sha2("content", 256).alias("now")), "file_path").where("now <> content_hash").select("id", "file_path")


def volatility_overrides(entities: DataFrame) -> DataFrame:
    """(id, type) of rules and knowledge that an explicit record mark takes out of drift tracking."""
    natural = (F.col("type") == "knowledge") & F.coalesce(_property("category").isin(*RECORD_CATEGORIES), F.lit(False))
    return entities.where(F.col("type").isin("rule", "knowledge") & (_property("volatility") == "record") & ~natural).select("id", "type")


def orphaned_supersedes(entities: DataFrame) -> DataFrame:
    """(id, type) of superseded entities that do not say by what."""
    return entities.where((F.col("status") == "superseded") & _property("superseded_by").isNull()).select("id", "type")
