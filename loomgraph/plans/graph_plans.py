"""Registered queries: graph, usage log, consolidation, ingest, relational extras."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import exprs
from loomgraph.functions.constants import PIPE_SHELLS, SECRETS, TRANSITIONS
from loomgraph.operators import consolidate, fusion, graph, ingest, pack, usage
from loomgraph.plans import adapters as A


def k_hop(spark, d):
    seeds = A.read(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("seed"), F.concat(F.lit("r:"), "r_regionkey").alias("id"))
    return graph.k_hop(A.edge_table(spark, d), seeds, 2).select("seed", "id", F.col("depth").cast("long").alias("depth"))


def expand_paths(spark, d):
    seeds = A.read(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"))
    out = graph.expand_paths(A.edge_table(spark, d), seeds, 2)
    return out.select("id", F.col("depth").cast("long").alias("depth"), "seed", F.array_join("path", ">").alias("path"), F.array_join("edge_path", ">").alias("edge_path"), "weight")


def path_descriptions(spark, d):
    seeds = A.read(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"))
    titles = A.read(spark, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.col("n_name").alias("title")).unionByName(A.read(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("id"), F.col("r_name").alias("title")))
    return graph.describe_paths(graph.expand_paths(A.edge_table(spark, d), seeds, 1), titles).select("id", "description")


def graph_first(spark, d):
    seeds = A.read(spark, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), (1 / (1 + F.col("n_nationkey") / F.lit(20.0))).alias("weight"))
    return graph.graph_first(A.edge_table(spark, d), seeds).select("id", F.round("score", 6).alias("score"), "direct")


def callers(spark, d):
    ids = A.code_entities(spark, d).where("type = 'class'").select("id")
    return graph.callers(A.edges(spark, d), ids).select("id", "caller")


def impact_set(spark, d):
    ids = A.code_entities(spark, d).where("type = 'class'").select("id")
    kind = F.when(F.col("edge_type") == "contains", "imports").otherwise(F.col("edge_type"))
    chain = A.edge_table(spark, d).withColumn("edge_type", kind)
    return graph.impact_set(chain, ids, 2).groupBy("root", "depth", "via_edge").agg(F.count("*").alias("n")).select("root", F.col("depth").cast("long").alias("depth"), "via_edge", "n")


def orphans(spark, d):
    return graph.orphans(A.code_entities(spark, d), A.edges(spark, d)).select("id", "file_path")


def knowledge_refs(spark, d):
    c = A.read(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("knowledge").alias("type"), F.when(F.col("c_acctbal") < 0, "stale").otherwise("active").alias("status"))
    return graph.referencing(c, A.edges(spark, d), "knowledge")


def references_map(spark, d):
    return graph.references_map(A.edges(spark, d)).select("source_id", F.array_join("targets", ",").alias("targets"))


def file_siblings(spark, d):
    members = A.code_entities(spark, d).where("type = 'function'").select("id")
    return graph.siblings(members, A.edges(spark, d)).groupBy("id").agg(F.count("*").alias("siblings"))


def edge_resolution(spark, d):
    sups = A.code_entities(spark, d).where("type = 'class'").select("id", F.col("title").alias("qualified_name"))
    li = A.read(spark, d, "lineitem").join(A.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("mod::"), "s_name")).otherwise(F.col("s_name"))
    raw = li.select(F.concat(F.lit("p:"), "l_partkey").alias("source_id"), name.alias("target_name"), F.lit("calls").alias("edge_type"))
    return graph.resolve_edges(raw, sups)


def contains_links(spark, d):
    passages = A.read(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return graph.contains_links(passages, A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def curated_in_degree(spark, d):
    return fusion.curated_in_degree(A.edges(spark, d))


def provenance_prior(spark, d):
    scores = A.read(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return fusion.provenance_prior(scores, A.edges(spark, d)).select("id", F.round("score", 4).alias("score"), "in_degree")


def drift_demote(spark, d):
    scores = A.read(spark, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    drift = A.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("p:"), "l_partkey").alias("entity_id"))
    return fusion.demote_drifted(scores, drift).select("id", F.round("score", 6).alias("score"), "drift_count")


def cold_start_topk(spark, d):
    e = A.doc_entities(spark, d).where("status = 'active'")
    confidence = F.when(F.col("type") == "rule", 0.8).otherwise(0.5)
    age = F.floor((F.lit(A.EPOCH + 31 * 86400) - F.unix_timestamp("created_at")) / 86400)
    scored = e.select("id", "type", exprs.cold_start_score(confidence, F.col("doc_id") % 9, age).alias("score"))
    order = Window.partitionBy("type").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("type", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _cochange(spark, d):
    li, o, p = (A.read(spark, d, t) for t in ("lineitem", "orders", "part"))
    joined = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.explode(F.split("p_name", " ")).alias("term"), F.concat(F.lit("s:"), "l_suppkey").alias("entity_id"), F.concat(F.lit("o:"), "o_orderkey").alias("commit_id"), F.unix_timestamp("o_orderdate").alias("commit_ts")).distinct()


def cochange_candidates(spark, d):
    terms = A.read(spark, d, "part").select(F.col("p_name").alias("query_id")).distinct().select("query_id", F.explode(F.array_distinct(F.split("query_id", " "))).alias("term"))
    out = graph.cochange_candidates(_cochange(spark, d), terms, 883612800)
    return out.select("query_id", "id", "hits", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def hunk_overlap(spark, d):
    o = A.read(spark, d, "orders")
    hunks = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("commit_id"), F.unix_timestamp("o_orderdate").alias("hunk_start"), (F.unix_timestamp("o_orderdate") + 30 * 86400).alias("hunk_end"))
    ranges = hunks.select("path", F.col("commit_id").alias("id"), F.col("hunk_start").alias("line_start"), F.col("hunk_end").alias("line_end"))
    return ingest.overlapping_hunks(hunks, ranges).where("commit_id <> id")


def hit_attribution(spark, d):
    return usage.deliveries(A.log(spark, d)).select("delivery_id", "actor", "key", "closed", "outcome")


def hit_rates(spark, d):
    return usage.usage_rates(usage.deliveries(A.log(spark, d)), ["key"]).select("key", "hits", "misses", "pending", F.round("rate", 6).alias("rate"))


def saves_after_anchor(spark, d):
    return usage.saves_after(A.log(spark, d))


def search_miss(spark, d):
    return usage.search_misses(A.log(spark, d))


def uncharted_edit(spark, d):
    return usage.uncharted_edits(A.log(spark, d))


def recurring_use(spark, d):
    return usage.recurring_use(usage.deliveries(A.log(spark, d)))


def hot_keys(spark, d):
    return usage.hot_keys(A.log(spark, d))


def error_fix(spark, d):
    return usage.error_fixes(A.log(spark, d)).select("error_id", "fix_id", F.col("distance").cast("long").alias("distance"))


def dead_weight(spark, d):
    parts = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    used = A.read(spark, d, "events").where("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("long").alias("key"), "ts")
    return usage.dead_weight(parts, used)


def nth_session(spark, d):
    return usage.nth_latest(A.log(spark, d).where("kind = 'boundary'"), 3, ["actor"]).select("actor", "id")


def retention_sweep(spark, d):
    return usage.retained(A.log(spark, d), "2024-02-09 00:00:00").groupBy("kind").agg(F.count("*").alias("n"))


def title_duplicates(spark, d):
    return consolidate.title_duplicates(A.doc_entities(spark, d)).select("id", "match_id", "similarity", "via")


def length_ratio_pairs(spark, d):
    e = A.doc_entities(spark, d)
    nxt = F.lead("id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = e.select("id", nxt.alias("other"), F.lit(1.0).alias("similarity")).where("other is not null")
    return consolidate.contradiction_pairs(pairs, e).select("id", "other", F.round("ratio", 6).alias("ratio"))


def promotion_candidates(spark, d):
    c = A.read(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("observation").alias("type"), F.lit("active").alias("status"))
    return consolidate.promotion_candidates(c, A.edges(spark, d))


def merge_pairs(spark, d):
    e = A.doc_entities(spark, d)
    pairs = consolidate.title_duplicates(e, 0.9).select(F.col("match_id").alias("id"), F.col("id").alias("other"), "similarity").join(e.select(F.col("id").alias("other"), F.lower("title").alias("block")), "other")
    return consolidate.merge_plan(pairs, e).select("survivor", "loser", "similarity")


def prune_candidates(spark, d):
    return consolidate.prune_candidates(A.doc_entities(spark, d), "2024-04-01 12:00:00").select("id", "age_days")


def line_jaccard(spark, d):
    sections = A.doc_texts(spark, d).select(F.col("source").alias("group_id"), "id", "content")
    return consolidate.line_jaccard(sections).select("group_id", "id", "other", F.round("similarity", 6).alias("similarity"))


def secret_scan(spark, d):
    return A.doc_entities(spark, d).select("id", exprs.secret_kind(F.concat_ws("\n", "title", "content")).alias("kind")).where("kind is not null")


def secret_redaction(spark, d):
    return A.doc_entities(spark, d).select("id", F.sha2(exprs.redact(F.col("content")), 256).alias("clean"))


def suspicious_rules(spark, d):
    return A.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.array_join(exprs.suspicious(F.col("html")), ", ").alias("markers"))


def category_typos(spark, d):
    words = A.read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("category"))
    return consolidate.category_typos(words.groupBy("category").agg(F.count("*").alias("n")))


def corrupt_json(spark, d):
    broken = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return consolidate.corrupt_json(A.read(spark, d, "events").select("event_id", broken.alias("payload")), "payload").select("event_id")


def snapshot_diff(spark, d):
    old = A.doc_entities(spark, d).where("status <> 'rejected'").select("id", "content_hash", "status")
    new = A.doc_entities(spark, d).where("doc_id % 10 <> 2").select("id", F.when(F.col("doc_id") % 10 == 1, F.sha2(F.upper("content"), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return ingest.snapshot_diff(old, new)


def _references(spark, d):
    code = A.code_entities(spark, d).select(F.col("id").alias("code_id"), "content_hash")
    li = A.read(spark, d, "lineitem").select(F.concat(F.lit("o:"), "l_orderkey").alias("entity_id"), F.concat(F.lit("p:"), "l_partkey").alias("code_id"), "l_linenumber").groupBy("entity_id", "code_id").agg(F.min("l_linenumber").alias("n"))
    return li.join(code, "code_id", "left").select("entity_id", "code_id", F.when(F.col("n") % 5 == 0, F.lit(None)).when(F.col("n") % 3 == 0, "other").otherwise(F.col("content_hash")).alias("verified_hash"))


_REFERENCES = """li AS (SELECT 'o:' || l_orderkey AS entity_id, 'p:' || l_partkey AS code_id, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
ref AS (SELECT entity_id, code_id, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 3 = 0 THEN 'other' ELSE c.content_hash END AS verified_hash FROM li LEFT JOIN code c ON c.id = code_id)"""


def drift_recompute(spark, d):
    return ingest.drift(A.code_entities(spark, d), _references(spark, d))


def reanchor(spark, d):
    return ingest.reanchor(_references(spark, d), A.code_entities(spark, d))


def _knowledge(spark, d):
    orders = A.read(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.lit("knowledge").alias("type"), F.when(F.col("o_orderkey") % 4 == 0, "stale").otherwise("active").alias("status"))
    return orders.unionByName(A.code_entities(spark, d).where("type = 'function'").select("id", "type", "status"))


_KNOWLEDGE = """k AS (SELECT 'o:' || o_orderkey AS id, 'knowledge' AS type, CASE WHEN o_orderkey % 4 = 0 THEN 'stale' ELSE 'active' END AS status FROM orders
UNION ALL SELECT id, type, status FROM code WHERE type = 'function')"""


def _anchors(spark, d):
    return A.edges(spark, d).where("edge_type = 'contains'").withColumn("edge_type", F.lit("references"))


def stale_flags(spark, d):
    return ingest.stale_flags(_knowledge(spark, d), _anchors(spark, d)).select("id")


def healed(spark, d):
    return ingest.healed(_knowledge(spark, d), _anchors(spark, d)).select("id")


def is_test_path(spark, d):
    return A.code_entities(spark, d).select("id", exprs.is_test_path(F.col("file_path")).alias("is_test"), exprs.language(F.col("file_path")).alias("language"))


def status_transitions(spark, d):
    names = spark.createDataFrame([(s,) for s in TRANSITIONS], "old string")
    return names.join(names.withColumnRenamed("old", "new")).select("old", "new", exprs.may_become(F.col("old"), F.col("new")).alias("legal"))


def query_entities(spark, d):
    """A page of 50 for every target at once."""
    e = A.code_entities(spark, d).where("type = 'file' and status = 'active'")
    wanted = A.edges(spark, d).where("edge_type = 'supports'").select(F.col("source_id").alias("id"), F.col("target_id").alias("target"))
    order = Window.partitionBy("target").orderBy(F.desc("title"), "id")
    return e.join(wanted, "id").withColumn("r", F.row_number().over(order)).where("r <= 50").select("target", "id", "title")


def entity_counts(spark, d):
    return A.doc_entities(spark, d).groupBy("type", "status").agg(F.count("*").alias("n"))


def code_map(spark, d):
    e = A.code_entities(spark, d).where("type = 'function'").withColumn("file_path", F.regexp_replace("file_path", "[0-9]+[.]rs$", "m.rs"))
    return pack.code_map(e)


def volatility(spark, d):
    e = A.doc_entities(spark, d)
    category = F.when(F.col("doc_id") % 4 == 0, "incident").otherwise("design")
    explicit = F.when(F.col("doc_id") % 11 == 0, "living").when(F.col("doc_id") % 13 == 0, "odd")
    return e.select("id", exprs.volatility(F.col("type"), explicit, category).alias("volatility"))


def excerpts(spark, d):
    e = A.doc_entities(spark, d)
    return e.select("id", F.sha2(exprs.excerpt(F.col("content"), 4), 256).alias("excerpt"), exprs.token_estimate(F.col("content")).alias("tokens"))


def event_windows(spark, d):
    """Native extra: tumbling hours."""
    e = A.read(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_timestamp(F.col("window.start")).alias("start"), "event_type", "n", "total")


def event_sessions(spark, d):
    """Native extra: sessions of a user, closed by six hours of silence."""
    e = A.read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_timestamp(F.col("session_window.start")).alias("start"), "n")


def order_cube(spark, d):
    """Native extra: grouping sets."""
    return A.read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}

_SECRET_SQL = " ".join("WHEN regexp_matches(body, '{}') THEN '{}'".format(p.replace("'", "''"), k) for k, p in SECRETS)
_SHELLS = "|".join(sorted(PIPE_SHELLS, key=len, reverse=True))

ORACLES = {
    "k_hop": f"""WITH {A.EDGES}, b AS (SELECT source_id AS node, target_id AS nb FROM edge UNION SELECT target_id, source_id FROM edge),
        s AS (SELECT 'r:' || r_regionkey AS id FROM region), h1 AS (SELECT DISTINCT s.id AS seed, nb AS id FROM s JOIN b ON node = s.id WHERE nb <> s.id),
        h2 AS (SELECT DISTINCT seed, nb AS id FROM h1 JOIN b ON node = h1.id WHERE nb <> seed)
        SELECT seed, id, CAST(1 AS BIGINT) AS depth FROM h1 UNION ALL SELECT seed, id, 2 FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = h2.seed AND h1.id = h2.id)""",
    "expand_paths": f"""WITH {A.EDGES}, b AS (SELECT source_id AS node, target_id AS nb, source_id, target_id, edge_type FROM edge UNION ALL SELECT target_id, source_id, source_id, target_id, edge_type FROM edge),
        w AS (SELECT *, CASE WHEN edge_type IN ('references', 'supports') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM b), s AS (SELECT 'r:' || r_regionkey AS id FROM region),
        c1 AS (SELECT nb AS id, s.id AS seed, s.id || '>' || nb AS path, edge_type AS edge_path, w AS weight, row_number() OVER (PARTITION BY nb ORDER BY w DESC, source_id, target_id, edge_type) AS r FROM s JOIN w ON node = s.id WHERE nb NOT IN (SELECT id FROM s)),
        h1 AS (SELECT * FROM c1 WHERE r = 1),
        c2 AS (SELECT nb AS id, seed, path || '>' || nb AS path, edge_path || '>' || edge_type AS edge_path, weight * w AS weight, row_number() OVER (PARTITION BY nb ORDER BY w DESC, source_id, target_id, edge_type) AS r FROM h1 JOIN w ON node = h1.id WHERE nb NOT IN (SELECT id FROM s) AND nb NOT IN (SELECT id FROM h1))
        SELECT id, CAST(1 AS BIGINT) AS depth, seed, path, edge_path, weight FROM h1 UNION ALL SELECT id, 2, seed, path, edge_path, weight FROM c2 WHERE r = 1""",
    "path_descriptions": "SELECT 'n:' || n_nationkey AS id, r_name || ' → references → ' || n_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey",
    "graph_first": f"""WITH {A.EDGES}, b AS (SELECT source_id AS node, target_id AS nb FROM edge WHERE edge_type IN ('references', 'supports') UNION SELECT target_id, source_id FROM edge WHERE edge_type IN ('references', 'supports')),
        s AS (SELECT 'n:' || n_nationkey AS id, 1 / (1 + n_nationkey / 20.0::DOUBLE) AS weight FROM nation), h1 AS (SELECT DISTINCT s.id AS seed, nb AS id FROM s JOIN b ON node = s.id),
        h2 AS (SELECT DISTINCT seed, nb AS id FROM h1 JOIN b ON node = h1.id WHERE nb <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = nb)),
        a AS (SELECT seed, id, 1 AS h FROM h1 UNION ALL SELECT seed, id, 2 FROM h2),
        t AS (SELECT a.id, sum(weight * pow(0.5, h)) AS score, bool_or(h = 1) AS direct FROM a JOIN s ON s.id = a.seed GROUP BY a.id)
        SELECT id, round(score, 6) AS score, direct FROM t WHERE score >= 0.2 AND id NOT IN (SELECT id FROM s)""",
    "callers": f"WITH {A.EDGES} SELECT target_id AS id, source_id AS caller FROM edge WHERE edge_type = 'calls'",
    "impact_set": f"""WITH {A.EDGES}, h1 AS (SELECT target_id AS root, source_id AS id FROM edge WHERE edge_type = 'calls'),
        h2 AS (SELECT DISTINCT root, e.source_id AS id FROM h1 JOIN edge e ON e.target_id = h1.id AND e.edge_type = 'contains')
        SELECT root, CAST(1 AS BIGINT) AS depth, 'calls' AS via_edge, count(*) AS n FROM h1 GROUP BY root UNION ALL SELECT root, 2, 'imports', count(*) FROM h2 GROUP BY root""",
    "orphans": f"WITH {A.EDGES}, {A.CODE} SELECT id, file_path FROM code WHERE status = 'active' AND NOT (file_path LIKE '%.rs' AND contains(file_path, '/tests/')) AND id NOT IN (SELECT target_id FROM edge WHERE edge_type = 'calls')",
    "knowledge_refs": "SELECT 'n:' || c_nationkey AS target_id, 'c:' || c_custkey AS id FROM customer WHERE c_acctbal >= 0",
    "references_map": "SELECT 'c:' || c_custkey AS source_id, 'n:' || c_nationkey AS targets FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation",
    "file_siblings": f"""WITH {A.EDGES}, c AS (SELECT source_id AS f, target_id AS m FROM edge WHERE edge_type = 'contains'),
        s AS (SELECT DISTINCT a.m AS id, b.m AS sibling FROM c a JOIN c b ON a.f = b.f AND a.m <> b.m UNION SELECT m, f FROM c) SELECT id, count(*) AS siblings FROM s GROUP BY id""",
    "edge_resolution": """WITH u AS (SELECT s_name FROM supplier GROUP BY s_name HAVING count(*) = 1)
        SELECT DISTINCT 'p:' || l_partkey AS source_id, 's:' || l_suppkey AS target_id, 'calls' AS edge_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_name IN (SELECT s_name FROM u)""",
    "contains_links": "SELECT item_id AS passage_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "curated_in_degree": f"WITH {A.EDGES} SELECT target_id AS id, count(*) AS in_degree FROM edge WHERE edge_type IN ('references', 'supports') GROUP BY target_id",
    "provenance_prior": "SELECT 'c:' || c_custkey AS id, round(c_acctbal * (1 + 0.3 * ln(1 + coalesce(n, 0))), 4) AS score, coalesce(n, 0) AS in_degree FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "drift_demote": "SELECT 'p:' || p_partkey AS id, round(p_retailprice * pow(0.7, coalesce(n, 0)), 6) AS score, coalesce(n, 0) AS drift_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON l_partkey = p_partkey",
    "cold_start_topk": f"""WITH {A.ENTITIES}, s AS (SELECT id, type, 0.3 * CASE type WHEN 'rule' THEN 0.8 ELSE 0.5 END + 0.1 * ln(doc_id % 9 + 1.0::DOUBLE) + 0.2 * pow(2.0::DOUBLE, -floor(({A.EPOCH} + 31 * 86400 - created) / 86400.0) / 14.0) AS score FROM ent WHERE status = 'active')
        SELECT type, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 20""",
    "cochange_candidates": """WITH c AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term, 's:' || l_suppkey AS entity_id, 'o:' || o_orderkey AS commit_id, epoch(o_orderdate) AS ts FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
        past AS (SELECT * FROM c WHERE ts < 883612800), df AS (SELECT term, count(DISTINCT commit_id) AS df FROM past GROUP BY term),
        t AS (SELECT DISTINCT p_name AS query_id, unnest(string_split(p_name, ' ')) AS term FROM part),
        h AS (SELECT query_id, entity_id AS id, sum(1.0::DOUBLE / df) AS idf, count(*) AS hits, count(DISTINCT term) AS ov FROM past JOIN df USING (term) JOIN t USING (term) GROUP BY query_id, entity_id),
        s AS (SELECT *, 0.07 + 0.08 * idf / (idf + 3) + 0.05 * least(ov, 3) + 0.005 * least(hits, 8) AS score FROM h)
        SELECT query_id, id, hits, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 20""",
    "hunk_overlap": "SELECT DISTINCT a.o_orderkey AS commit_id, b.o_orderkey AS id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate + INTERVAL 30 DAY >= a.o_orderdate",
    "hit_attribution": f"""WITH {A.LOG} SELECT o.id AS delivery_id, o.actor, o.key, o.stage < top AS closed,
        CASE WHEN EXISTS (SELECT 1 FROM bounded t WHERE t.actor = o.actor AND t.key = o.key AND t.kind = 'touch' AND t.stage = o.stage AND (t.ts > o.ts OR (t.ts = o.ts AND t.id > o.id))) THEN 'hit' WHEN o.stage < top THEN 'miss' ELSE 'pending' END AS outcome
        FROM bounded o JOIN last_stage USING (actor) WHERE o.kind = 'open'""",
    "error_fix": f"""WITH {A.LOG}, c AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts, id) AS pos FROM log WHERE kind IN ('tool_ok', 'tool_error')),
        m AS (SELECT e.id AS error_id, o.id AS fix_id, o.pos - e.pos AS distance, row_number() OVER (PARTITION BY e.id ORDER BY o.pos) AS r FROM c e JOIN c o ON e.actor = o.actor AND e.tool = o.tool AND e.kind = 'tool_error' AND o.kind = 'tool_ok' AND o.pos > e.pos AND o.pos <= e.pos + 20)
        SELECT error_id, fix_id, distance FROM m WHERE r = 1""",
    "dead_weight": "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'view')",
    "nth_session": f"WITH {A.LOG} SELECT actor, id FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts DESC, id DESC) AS n FROM log WHERE kind = 'boundary') WHERE n = 3",
    "retention_sweep": f"WITH {A.LOG} SELECT kind, count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-02-09 00:00:00' - INTERVAL 30 DAY GROUP BY kind",
    "hot_keys": f"WITH {A.LOG} SELECT key, count(*) AS saves, count(DISTINCT CAST(ts AS DATE)) AS days FROM log WHERE kind = 'touch' GROUP BY key HAVING count(*) >= 3 AND count(DISTINCT CAST(ts AS DATE)) >= 2",
    "title_duplicates": rf"""WITH {A.ENTITIES}, k AS (SELECT id, type, created, lower(title) AS low, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key FROM ent),
        m AS (SELECT *, lag(id) OVER (PARTITION BY type, key, low ORDER BY created, id) AS same, lag(id) OVER (PARTITION BY type, key ORDER BY created, id) AS near FROM k WHERE key <> '')
        SELECT id, coalesce(same, near) AS match_id, CASE WHEN same IS NOT NULL THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS similarity, CASE WHEN same IS NOT NULL THEN 'exact' ELSE 'fuzzy' END AS via FROM m WHERE near IS NOT NULL""",
    "length_ratio_pairs": f"""WITH {A.ENTITIES}, p AS (SELECT id, content AS a, lead(id) OVER w AS other, lead(content) OVER w AS b FROM ent WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
        r AS (SELECT id, other, greatest(length(lower(a)), length(lower(b))) AS hi, least(length(lower(a)), length(lower(b))) AS lo FROM p WHERE other IS NOT NULL AND lower(a) <> lower(b))
        SELECT id, other, round(hi / lo::DOUBLE, 6) AS ratio FROM r WHERE lo > 0 AND hi <= 5 * lo""",
    "promotion_candidates": "SELECT 'c:' || o_custkey AS id, count(DISTINCT o_orderkey) AS supporters FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 3",
    "prune_candidates": f"WITH {A.ENTITIES} SELECT id, CAST(floor((1711972800 - created) / 86400.0) AS BIGINT) AS age_days FROM ent WHERE type = 'observation' AND status IN ('rejected', 'superseded') AND floor((1711972800 - created) / 86400.0) >= 90",
    "line_jaccard": f"""WITH {A.ENTITIES}, l AS (SELECT DISTINCT source AS g, id, trim(unnest(string_split(content, chr(10)))) AS line FROM ent), k AS (SELECT * FROM l WHERE length(line) > 3),
        n AS (SELECT g, id, count(*) AS n FROM k GROUP BY g, id),
        b AS (SELECT a.g, a.id, b.id AS other, count(*) AS common FROM k a JOIN k b ON a.g = b.g AND a.line = b.line AND a.id < b.id GROUP BY a.g, a.id, b.id)
        SELECT b.g AS group_id, b.id, b.other, round(common / (x.n + y.n - common)::DOUBLE, 6) AS similarity FROM b JOIN n x ON x.g = b.g AND x.id = b.id JOIN n y ON y.g = b.g AND y.id = b.other WHERE common / (x.n + y.n - common)::DOUBLE >= 0.5""",
    "secret_scan": f"WITH {A.ENTITIES}, b AS (SELECT id, title || chr(10) || content AS body FROM ent), s AS (SELECT id, CASE {_SECRET_SQL} END AS kind FROM b) SELECT id, kind FROM s WHERE kind IS NOT NULL",
    "corrupt_json": "SELECT event_id FROM events WHERE NOT json_valid(CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 3) ELSE props END)",
    "snapshot_diff": f"""WITH {A.ENTITIES}, o AS (SELECT id, content_hash AS oh, status FROM ent WHERE status <> 'rejected'), n AS (SELECT id, CASE WHEN doc_id % 10 = 1 THEN sha256(upper(content)) ELSE content_hash END AS nh FROM ent WHERE doc_id % 10 <> 2)
        SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN CASE status WHEN 'active' THEN 'stale' ELSE 'skip' END WHEN status = 'stale' THEN 'reactivate' WHEN oh = nh THEN 'skip' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id""",
    "drift_recompute": f"WITH {A.CODE}, {_REFERENCES}, x AS (SELECT entity_id, code_id, CASE WHEN c.id IS NULL OR c.status <> 'active' THEN 'missing' WHEN verified_hash IS NULL THEN 'unverified' WHEN verified_hash <> c.content_hash THEN 'changed' END AS cause FROM ref LEFT JOIN code c ON c.id = code_id) SELECT * FROM x WHERE cause IS NOT NULL",
    "reanchor": f"""WITH {A.CODE}, {_REFERENCES}, s AS (SELECT * FROM code WHERE status = 'stale'), a AS (SELECT * FROM code WHERE status = 'active'),
        m AS (SELECT s.id, count(*) AS k, min(a.id) AS one, count(*) FILTER (a.type = s.type AND a.title = s.title) AS kn, min(a.id) FILTER (a.type = s.type AND a.title = s.title) AS named FROM s JOIN a ON a.content_hash = s.content_hash GROUP BY s.id)
        SELECT entity_id, code_id AS old_id, CASE WHEN k = 1 THEN one ELSE named END AS new_id FROM ref JOIN m ON m.id = code_id WHERE k = 1 OR kn = 1""",
    "stale_flags": f"WITH {A.CODE}, {A.EDGES}, {_KNOWLEDGE} SELECT id FROM k WHERE type = 'knowledge' AND status = 'active' AND id IN (SELECT source_id FROM edge JOIN code ON code.id = target_id WHERE edge_type = 'contains' AND code.status = 'stale')",
    "healed": f"WITH {A.CODE}, {A.EDGES}, {_KNOWLEDGE} SELECT id FROM k WHERE type = 'knowledge' AND status = 'stale' AND id NOT IN (SELECT source_id FROM edge JOIN code ON code.id = target_id WHERE edge_type = 'contains' AND code.status <> 'active')",
    "is_test_path": f"WITH {A.CODE} SELECT id, file_path LIKE '%.rs' AND contains(file_path, '/tests/') AS is_test, CASE type WHEN 'function' THEN 'rust' WHEN 'class' THEN 'python' ELSE 'go' END AS language FROM code",
    "status_transitions": "WITH s AS (SELECT unnest(['active', 'stale', 'rejected', 'superseded', 'pruned']) AS s) SELECT a.s AS old, b.s AS new, (a.s IN ('active', 'stale') AND b.s IN ('active', 'stale', 'rejected', 'superseded') AND a.s <> b.s) OR (a.s IN ('rejected', 'superseded') AND b.s = 'pruned') AS legal FROM s a, s b",
    "query_entities": "SELECT target, id, title FROM (SELECT 'c:' || o_custkey AS target, 'o:' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR) DESC, 'o:' || o_orderkey) AS r FROM orders) WHERE r <= 50",
    "entity_counts": f"WITH {A.ENTITIES} SELECT type, status, count(*) AS n FROM ent GROUP BY type, status",
    "code_map": f"WITH {A.CODE}, f AS (SELECT regexp_replace(file_path, '[0-9]+[.]rs$', 'm.rs') AS file_path, count(*) AS symbols FROM code WHERE type = 'function' AND status = 'active' GROUP BY 1 ORDER BY symbols DESC, file_path LIMIT 50) SELECT file_path, symbols FROM f WHERE NOT contains(file_path, '/tests/') ORDER BY symbols DESC, file_path LIMIT 15",
    "volatility": f"WITH {A.ENTITIES} SELECT id, CASE WHEN doc_id % 11 = 0 THEN 'living' WHEN type = 'observation' OR (type = 'knowledge' AND doc_id % 4 = 0) THEN 'record' ELSE 'living' END AS volatility FROM ent",
    "excerpts": f"WITH {A.ENTITIES}, l AS (SELECT id, content, string_split(content, chr(10)) AS l FROM ent) SELECT id, sha256(CASE WHEN len(l) > 4 THEN array_to_string(l[1:4], chr(10)) || chr(10) || '... (' || (len(l) - 4) || ' more lines)' ELSE content END) AS excerpt, CAST(floor(length(content) / 4.0) AS BIGINT) AS tokens FROM l",
    "event_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, s",
    "order_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "suspicious_rules": rf"""SELECT page_id AS id, array_to_string(list_filter([CASE WHEN contains(html, 'http://') OR contains(html, 'https://') THEN 'URL' END,
        CASE WHEN regexp_matches(html, '(^|[^|])\|\s*({_SHELLS})($|[^\p{{L}}\p{{N}}_])') THEN 'pipe-to-shell' END], lambda x: x IS NOT NULL), ', ') AS markers FROM pages""",
}
ORACLES["hit_rates"] = f"WITH u AS ({ORACLES['hit_attribution']}), c AS (SELECT key, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'pending') AS pending FROM u GROUP BY key) SELECT *, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses)::DOUBLE END, 6) AS rate FROM c"
ORACLES["recurring_use"] = f"SELECT key, count(*) AS hits FROM ({ORACLES['hit_attribution']}) WHERE outcome = 'hit' GROUP BY key HAVING count(*) >= 2"
ORACLES["saves_after_anchor"] = f"WITH {A.LOG} SELECT o.id AS anchor_id, o.actor, count(DISTINCT t.key) AS saves FROM bounded o JOIN bounded t ON t.actor = o.actor AND t.stage = o.stage AND t.kind = 'touch' AND (t.ts > o.ts OR (t.ts = o.ts AND t.id > o.id)) WHERE o.kind = 'open' GROUP BY o.id, o.actor"
ORACLES["search_miss"] = f"SELECT s.* FROM ({ORACLES['saves_after_anchor']}) s JOIN events ON event_id = anchor_id WHERE value < 1"
ORACLES["uncharted_edit"] = f"SELECT s.* FROM ({ORACLES['saves_after_anchor']}) s WHERE anchor_id IN (SELECT delivery_id FROM ({ORACLES['hit_attribution']}) WHERE outcome <> 'hit')"
ORACLES["category_typos"] = r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS category FROM benchmark), c AS (SELECT category, count(*) AS n FROM w GROUP BY category)
    SELECT DISTINCT a.category, b.likely FROM c a JOIN (SELECT category AS likely, n FROM c WHERE n >= 3) b ON a.n <= 2 AND levenshtein(a.category, b.likely) BETWEEN 1 AND 2
    UNION SELECT category, r FROM c JOIN (SELECT unnest(['decision', 'decisions', 'benchmark', 'replay', 'incident']) AS r) ON levenshtein(category, r) BETWEEN 1 AND 2"""
_REDACT = "content"
for _kind, _pattern in SECRETS:
    _REDACT = "regexp_replace({}, '{}', '[redacted: {}]', 'g')".format(_REDACT, _pattern.replace("'", "''"), _kind)
ORACLES["secret_redaction"] = f"WITH {A.ENTITIES} SELECT id, sha256({_REDACT}) AS clean FROM ent"
