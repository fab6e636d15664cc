"""Driver tables as the engine's tables: a DataFrame and a DuckDB CTE for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import Scratch

EPOCH = 1704067200  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memory entities."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "stale").otherwise("active")
    kind = F.when(F.col("doc_id") % 3 == 0, "observation").when(F.col("doc_id") % 3 == 1, "rule").otherwise("knowledge")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("d:"), "doc_id").alias("id"), kind.alias("type"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
        F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("file_path"), status.alias("status"),
        F.timestamp_seconds(EPOCH + 60 * F.col("doc_id")).alias("created_at"), F.sha2("text", 256).alias("content_hash"), "source", "doc_id",
    )


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, title, content and source of doc_entities(). Labels give no more than the status, so texts are not joined to them, unless
    they have a document several times over, which its entities then are too."""
    columns, docs = ("id", "type", "title", "content", "source"), read(spark, sf_dir, "documents")
    if not read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return doc_entities(spark, sf_dir).select(*columns)
    kind = F.when(F.col("doc_id") % 3 == 0, "observation").when(F.col("doc_id") % 3 == 1, "rule").otherwise("knowledge")
    return docs.select(F.concat(F.lit("d:"), "doc_id").alias("id"), kind.alias("type"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), "source")


ENTITIES = """ent AS (
  SELECT 'd:' || d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'observation' WHEN 1 THEN 'rule' ELSE 'knowledge' END AS type,
         substr(d.text, 1, 60) AS title, d.text AS content, d.source || '/doc_' || d.doc_id || '.md' AS file_path,
         CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 0 THEN 'stale' ELSE 'active' END AS status,
         1704067200 + 60 * d.doc_id AS created, sha256(d.text) AS content_hash, d.source AS source, d.doc_id AS doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, supplier and orders as functions, classes and files."""
    p, s, o = (read(spark, sf_dir, t) for t in ("part", "supplier", "orders"))
    parts = p.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.lit("function").alias("type"), F.col("p_name").alias("title"), F.concat(F.lit("src/"), F.when(F.col("p_size") % 5 == 0, "tests/").otherwise("lib/"), "p_partkey", F.lit(".rs")).alias("file_path"), F.when(F.col("p_size") % 7 == 0, "stale").otherwise("active").alias("status"), F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("content_hash"))
    sups = s.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.lit("class").alias("type"), F.col("s_name").alias("title"), F.concat(F.lit("lib/s"), "s_suppkey", F.lit(".py")).alias("file_path"), F.lit("active").alias("status"), F.sha2("s_name", 256).alias("content_hash"))
    ords = o.select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.lit("file").alias("type"), F.col("o_orderkey").cast("string").alias("title"), F.concat(F.lit("orders/o"), "o_orderkey", F.lit(".go")).alias("file_path"), F.lit("active").alias("status"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"))
    return parts.unionByName(sups).unionByName(ords)


CODE = """code AS (
  SELECT 'p:' || p_partkey AS id, 'function' AS type, p_name AS title, 'src/' || CASE WHEN p_size % 5 = 0 THEN 'tests/' ELSE 'lib/' END || p_partkey || '.rs' AS file_path,
         CASE WHEN p_size % 7 = 0 THEN 'stale' ELSE 'active' END AS status, sha256(p_name || '|' || p_brand) AS content_hash FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'class', s_name, 'lib/s' || s_suppkey || '.py', 'active', sha256(s_name) FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'file', CAST(o_orderkey AS VARCHAR), 'orders/o' || o_orderkey || '.go', 'active', sha256(CAST(o_orderkey AS VARCHAR)) FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, orders, customer and nation as typed edges."""
    li, o, c, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    make = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("source_id"), F.concat(F.lit(b), y).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))
    return (
        make(li.select("l_orderkey", "l_partkey").distinct(), "o:", "l_orderkey", "p:", "l_partkey", "contains")
        .unionByName(make(li.select("l_partkey", "l_suppkey").distinct(), "p:", "l_partkey", "s:", "l_suppkey", "calls"))
        .unionByName(make(c, "c:", "c_custkey", "n:", "c_nationkey", "references"))
        .unionByName(make(n, "n:", "n_nationkey", "r:", "n_regionkey", "references"))
        .unionByName(make(o, "o:", "o_orderkey", "c:", "o_custkey", "supports"))
    )


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(), written once for operators that read it at every hop."""
    return Scratch(spark, "edges").write(edges(spark, sf_dir), "edges")


EDGES = """edge AS (
  SELECT DISTINCT 'o:' || l_orderkey AS source_id, 'p:' || l_partkey AS target_id, 'contains' AS edge_type FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'calls' FROM lineitem
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'references' FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'references' FROM nation
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'supports' FROM orders)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the usage log."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "touch").when(F.col("event_type") == "purchase", "boundary").when(F.col("event_type") == "error", "tool_error").otherwise("tool_ok")
    key = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("actor"), kind.alias("kind"), (key % 10).alias("key"), (key % 5).alias("tool"), F.when(F.col("value") < 1, 0).otherwise(1).alias("returned"))


LOG = """log AS (
  SELECT event_id AS id, ts, user_id AS actor,
         CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'touch' WHEN 'purchase' THEN 'boundary' WHEN 'error' THEN 'tool_error' ELSE 'tool_ok' END AS kind,
         CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS key, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS tool, CASE WHEN value < 1 THEN 0 ELSE 1 END AS returned
  FROM events),
bounded AS (
  SELECT *, sum(CASE WHEN kind = 'boundary' THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY ts, id) AS stage FROM log),
last_stage AS (SELECT actor, max(stage) AS top FROM bounded GROUP BY actor)"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as a batch of queries."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25 = ENTITIES + r""",
tok AS (
  SELECT id, term, sum(w) AS tf, sum(t) AS title_tf, sum(1 - t) AS content_tf FROM (
    SELECT id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term, 5.0 AS w, 1 AS t FROM ent
    UNION ALL SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')), 1.0, 0 FROM ent) GROUP BY id, term),
len AS (SELECT id, len(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) + len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS dl FROM ent),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY term),
scored AS (
  SELECT q.query_id, t.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt q JOIN df USING (term) JOIN tok t USING (term) JOIN len USING (id), size GROUP BY q.query_id, t.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 20)"""
