"""Registered queries: filtered reads and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph, reads
from loomgraph.plans import adapters as A


def _entities(spark, d):
    """documents with properties, and the status of every thirteenth superseded."""
    category = F.element_at(F.array(*map(F.lit, ("design", "incident", "guide", "decision"))), (F.col("doc_id") % 4 + 1).cast("int"))
    properties = F.to_json(F.struct(
        F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 10) / 10).alias("confidence"), F.when(F.col("doc_id") % 5 != 0, category).alias("category"),
        F.array(F.concat(F.lit("t"), F.col("doc_id") % 7), F.concat(F.lit("u"), F.col("doc_id") % 5)).alias("tags"),
        F.when(F.col("doc_id") % 6 == 1, "record").alias("volatility"), F.when(F.col("doc_id") % 2 == 0, F.lit("d:1")).alias("superseded_by"),
        F.when(F.col("doc_id") % 8 != 0, F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))).alias("verified_against"),
    ))
    status = F.when(F.col("doc_id") % 13 == 0, "superseded").otherwise(F.col("status"))
    return A.doc_entities(spark, d).withColumns({"properties": properties, "status": status, "updated_at": F.col("created_at")})


def _drift(spark, d):
    e = A.read(spark, d, "documents").where("doc_id % 10 < 2")
    return e.select(F.concat(F.lit("d:"), "doc_id").alias("entity_id"), F.concat(F.lit("p:"), F.col("doc_id") % 50).alias("code_id"), F.when(F.col("doc_id") % 10 == 0, "unverified").otherwise("changed").alias("cause"))


_ENT = f"""{A.ENTITIES},
pe AS (
  SELECT id, type, title, file_path, content_hash, content, doc_id, created AS updated, CASE WHEN doc_id % 13 = 0 THEN 'superseded' ELSE status END AS status,
         CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 10) / 10.0 END AS confidence,
         CASE WHEN doc_id % 5 <> 0 THEN ['design', 'incident', 'guide', 'decision'][CAST(doc_id % 4 + 1 AS INTEGER)] END AS category,
         doc_id % 6 = 1 AS record, doc_id % 8 = 0 OR doc_id % 9 = 0 AS never FROM ent),
drift AS (
  SELECT 'd:' || doc_id AS entity_id, 'p:' || (doc_id % 50) AS code_id, CASE WHEN doc_id % 10 = 0 THEN 'unverified' ELSE 'changed' END AS cause
  FROM documents WHERE doc_id % 10 < 2),
living AS (
  SELECT * FROM pe WHERE type <> 'observation' AND NOT record AND coalesce(category, '') NOT IN ('incident', 'decision') AND status IN ('active', 'stale'))"""


def rules_by_confidence(spark, d):
    return reads.rules_by_confidence(_entities(spark, d)).select("id", "confidence")


def knowledge_filtered(spark, d):
    return reads.knowledge_filtered(_entities(spark, d), "active", "guide", ["t1", "u3"]).select("id", "title")


def to_verify(spark, d):
    entities, drift = _entities(spark, d), _drift(spark, d)
    parts = [reads.to_verify(entities, drift, s).select(F.lit(s).alias("selection"), "id", "title") for s in ("drifted", "stale", "unverified", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def drifted_on(spark, d):
    ids = A.read(spark, d, "part").where("p_size % 5 = 0").select(F.concat(F.lit("p:"), "p_partkey").alias("id"))
    return reads.drifted_on(_entities(spark, d), _drift(spark, d), ids)


def corpus_counts(spark, d):
    return reads.corpus_counts(_entities(spark, d), _drift(spark, d))


def events_of(spark, d):
    keys = spark.createDataFrame([(1,), (4,)], "id long")
    return reads.events_of(A.log(spark, d), keys, "touch").select("id", "actor", "key")


def _code(spark, d):
    """Code whose functions and files share paths."""
    e = A.code_entities(spark, d)
    folder = F.when(F.col("type") == "class", F.lit("none")).otherwise((F.regexp_extract("file_path", "([0-9]+)", 1).cast("long") % 97).cast("string"))
    return e.withColumn("file_path", F.concat(F.lit("m/"), folder))


_CODE = f"""{A.CODE}, c AS (
  SELECT id, type, 'm/' || CASE WHEN type = 'class' THEN 'none' ELSE CAST(CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) % 97 AS VARCHAR) END AS file_path FROM code),
f AS (SELECT file_path, min(id) AS file_id FROM c WHERE type = 'file' GROUP BY file_path)"""


def member_files(spark, d):
    e = _code(spark, d)
    return reads.with_file(e.where("type <> 'file'").select("id", "file_path"), e).select("id", "file_id")


def contains_edges(spark, d):
    return reads.contains_edges(_code(spark, d))


def section_order(spark, d):
    from pyspark.sql import Window

    e = A.doc_entities(spark, d).select(F.col("id").alias("entity_id"), F.when(F.col("doc_id") % 5 == 4, "class").when(F.col("doc_id") % 7 == 6, "code_map").otherwise(F.col("type")).alias("source"), ((F.col("doc_id") % 4) / 4).alias("relevance"), (F.col("doc_id") % 100).alias("pack"))
    place = lambda mode: F.row_number().over(Window.partitionBy("pack").orderBy(*reads.section_order(mode))).alias(mode)
    return e.select("pack", "entity_id", place("task"), place("cold_start"))


def decayed_expansion(spark, d):
    seeds = A.read(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), (1 / (1 + F.col("r_regionkey"))).alias("relevance"))
    paths = graph.expand_paths(A.edge_table(spark, d), seeds.select("id"), 2)
    return reads.decayed(paths, seeds, 0.01).select("id", "seed", F.round("relevance", 9).alias("relevance"))


def edited_observations(spark, d):
    e = A.doc_entities(spark, d)
    files = e.select("file_path", F.when(F.col("doc_id") % 12 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return reads.edited_observations(e, files)


def volatility_overrides(spark, d):
    return reads.volatility_overrides(_entities(spark, d))


def orphaned_supersedes(spark, d):
    return reads.orphaned_supersedes(_entities(spark, d))


QUERIES = {f.__name__: f for f in (rules_by_confidence, knowledge_filtered, to_verify, drifted_on, corpus_counts, events_of, member_files, contains_edges, section_order, decayed_expansion, edited_observations, volatility_overrides, orphaned_supersedes)}

_KIND = "CASE source WHEN 'identity' THEN 0 WHEN 'rule' THEN 1 WHEN 'knowledge' THEN 2 WHEN 'class' THEN 3 WHEN 'observation' THEN 4 ELSE 5 END"
ORACLES = {
    "rules_by_confidence": f"WITH {_ENT} SELECT id, CAST(coalesce(confidence, 1.0) AS DOUBLE) AS confidence FROM pe WHERE type = 'rule' AND status = 'active'",
    "knowledge_filtered": f"WITH {_ENT} SELECT id, title FROM pe WHERE type = 'knowledge' AND status = 'active' AND category = 'guide' AND (doc_id % 7 = 1 OR doc_id % 5 = 3)",
    "to_verify": f"""WITH {_ENT}
        SELECT DISTINCT 'drifted' AS selection, entity_id AS id, coalesce(title, '') AS title FROM drift LEFT JOIN pe ON pe.id = entity_id
        UNION ALL SELECT 'stale', id, coalesce(title, '') FROM pe WHERE status = 'stale'
        UNION ALL SELECT 'unverified', id, coalesce(title, '') FROM living WHERE never OR id IN (SELECT entity_id FROM drift WHERE cause = 'unverified')
        UNION ALL SELECT 'all', id, coalesce(title, '') FROM living""",
    "drifted_on": f"WITH {_ENT} SELECT DISTINCT id, title FROM pe JOIN drift ON entity_id = id WHERE code_id IN (SELECT 'p:' || p_partkey FROM part WHERE p_size % 5 = 0)",
    "corpus_counts": f"""WITH {_ENT}, n AS (SELECT count(*) FILTER (status = 'active' AND type IN ('rule', 'knowledge')) AS curated, count(*) FILTER (status = 'stale') AS stale FROM pe)
        SELECT curated, curated < 10 AS young, (SELECT count(DISTINCT entity_id) FROM drift) AS drifted, stale FROM n""",
    "events_of": f"WITH {A.LOG} SELECT id, actor, key FROM log WHERE kind = 'touch' AND key IN (1, 4)",
    "member_files": f"WITH {_CODE} SELECT id, file_id FROM c LEFT JOIN f USING (file_path) WHERE type <> 'file'",
    "contains_edges": f"WITH {_CODE} SELECT file_id AS source_id, id AS target_id, 'contains' AS edge_type FROM c JOIN f USING (file_path) WHERE type IN ('function', 'class')",
    "section_order": f"""WITH {A.ENTITIES}, s AS (SELECT id AS entity_id, CASE WHEN doc_id % 5 = 4 THEN 'class' WHEN doc_id % 7 = 6 THEN 'code_map' ELSE type END AS source, doc_id % 4 AS relevance, doc_id % 100 AS pack FROM ent)
        SELECT pack, entity_id, CAST(row_number() OVER (PARTITION BY pack ORDER BY relevance DESC, {_KIND}, entity_id) AS INTEGER) AS task,
               CAST(row_number() OVER (PARTITION BY pack ORDER BY {_KIND}, relevance DESC, entity_id) AS INTEGER) AS cold_start FROM s""",
    "decayed_expansion": """SELECT 'n:' || n_nationkey AS id, 'r:' || n_regionkey AS seed, round(CAST(0.3 AS DOUBLE) / (1 + n_regionkey), 9) AS relevance FROM nation
        UNION ALL SELECT 'c:' || c_custkey, 'r:' || n_regionkey, round(CAST(0.09 AS DOUBLE) / (1 + n_regionkey), 9) FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "edited_observations": f"WITH {A.ENTITIES} SELECT id, file_path FROM ent WHERE type = 'observation' AND doc_id % 12 = 0",
    "volatility_overrides": f"WITH {_ENT} SELECT id, type FROM pe WHERE type IN ('rule', 'knowledge') AND record AND NOT (type = 'knowledge' AND coalesce(category, '') IN ('incident', 'decision'))",
    "orphaned_supersedes": f"WITH {_ENT} SELECT id, type FROM pe WHERE status = 'superseded' AND doc_id % 2 <> 0",
}
