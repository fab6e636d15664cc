"""Registered queries: lexical search, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import exprs
from loomgraph.functions.constants import STOPWORDS
from loomgraph.operators import fusion, lexical, pack, search, vector
from loomgraph.plans import adapters as A
from loomgraph.session import Scratch

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS))


def _search(spark, d, k=20):
    corpus = search.Corpus(A.doc_texts(spark, d), A.edges(spark, d))
    return corpus, search.lexical_hits(corpus, A.search_queries(spark, d), k)


def bm25_topk(spark, d):
    _, (hits, *_) = _search(spark, d)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def doc_freq(spark, d):
    return lexical.Index(A.doc_texts(spark, d), lexical.query_terms(A.search_queries(spark, d))).df


def prf_terms(spark, d):
    corpus, (hits, _, terms, _) = _search(spark, d)
    out = lexical.feedback_terms(corpus.entities, hits, terms)
    return out.select("query_id", "term", F.col("score").cast("long").alias("score"), "df", F.col("rank").cast("long").alias("rank"))


def answer_coverage(spark, d):
    corpus, (hits, df, terms, n) = _search(spark, d)
    out = lexical.answer_coverage(corpus.entities, df, terms, hits, n)
    return out.select("query_id", F.round("coverage", 6).alias("coverage"))


def silence_gate(spark, d):
    corpus, (hits, df, terms, n) = _search(spark, d)
    kept = lexical.silence(hits, lexical.answer_coverage(corpus.entities, df, terms, hits, n))
    return kept.groupBy("query_id").agg(F.count("*").alias("hits"))


def content_terms(spark, d):
    return A.doc_entities(spark, d).select("id", F.size(F.array_distinct(exprs.content_terms(F.col("content")))).cast("long").alias("terms"))


def search_terms(spark, d):
    return A.doc_entities(spark, d).select("id", exprs.search_terms(F.regexp_replace("title", " ", "")).alias("terms"))


def _vectors(spark, d):
    e = A.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("type"))


def _knn(spark, d, keep=None):
    v = _vectors(spark, d)
    out = vector.knn(v, v.where("id = 0").select(F.col("embedding").alias("q")), 10, keep)
    return out.select("id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def knn_topk(spark, d):
    return _knn(spark, d)


def knn_filtered(spark, d):
    return _knn(spark, d, F.col("type") < 5)


def knn_self_topk(spark, d):
    return vector.knn_self(_vectors(spark, d), 10).select("id", "other", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def near_duplicate_pairs(spark, d):
    return vector.near_pairs(_vectors(spark, d), 0.35).select("id", "other", F.round("similarity", 6).alias("similarity"))


def _lists(spark, d):
    docs = A.read(spark, d, "documents").select(F.col("lang").alias("query_id"), F.concat(F.lit("d:"), "doc_id").alias("id"), "n_chars", "doc_id")
    by_size, by_id = (Window.partitionBy("query_id").orderBy(*o) for o in ((F.desc("n_chars"), "doc_id"), ("doc_id",)))
    a = docs.withColumn("rank", F.row_number().over(by_size)).select("query_id", "id", "rank", F.lit(0.3).alias("weight"), F.lit("code").alias("channel"))
    return a.unionByName(docs.withColumn("rank", F.row_number().over(by_id)).select("query_id", "id", "rank", F.lit(0.4).alias("weight"), F.lit("knowledge").alias("channel")))


_LISTS = """l AS (
  SELECT * FROM (
    SELECT lang AS query_id, 'd:' || doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, 0.3 AS weight, 'code' AS channel FROM documents
    UNION ALL SELECT lang, 'd:' || doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id), 0.4, 'knowledge' FROM documents))"""


def rrf_fuse(spark, d):
    return fusion.rrf(_lists(spark, d), ["query_id"]).select("query_id", "id", F.round("score", 9).alias("score"))


def channel_merge(spark, d):
    lists = _lists(spark, d)
    channels = fusion.rrf(lists, ["query_id", "channel"])
    weights = lists.select("query_id", "channel", F.when(F.col("channel") == "code", 0.25).otherwise(0.75).alias("weight")).distinct()
    return fusion.merge_channels(channels, weights, ["query_id"], 0.2).select("query_id", "channel", "id", F.round("score", 9).alias("score"))


def corroborated(spark, d):
    return fusion.corroborated(_lists(spark, d).where("rank > 10"), ["query_id"]).select("query_id", "id", "channels")


def first_emitter(spark, d):
    emitted = _lists(spark, d).select("query_id", "id", F.col("channel").alias("kind"), (1.0 / F.col("rank")).alias("score"))
    return fusion.first_emitter(emitted, {"knowledge": 1, "code": 2}).select("query_id", "id", "kind", F.round("score", 9).alias("score"))


def expansion_cap(spark, d):
    emitted = _lists(spark, d).select("query_id", "id", F.when(F.col("channel") == "code", "cochange").otherwise("graph").alias("kind"), (1.0 / F.col("rank")).alias("score"))
    out = fusion.capped_expansion(emitted, 20)
    return out.select("query_id", "id", "kind", F.col("rank").cast("long").alias("rank"))


def _signals(spark, d, radius=None):
    v = _vectors(spark, d)
    channel = F.when(F.col("type") < 5, "code").otherwise("knowledge")
    asked = v.where("id % 50 = 0").select(F.explode(F.array(F.lit("code"), F.lit("knowledge"))).alias("g"), "id", F.col("embedding").alias("e"))
    near = vector.nearest(asked, v.select(channel.alias("g"), "id", F.col("embedding").alias("e")), 5, radius, apart=True)
    return near.select(F.col("id").alias("query_id"), F.col("other").alias("id"), F.col("g").alias("channel"), "distance", "near")


_SIGNALS = """n AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, CASE WHEN v.label < 5 THEN 'code' ELSE 'knowledge' END AS channel, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY distance, id) AS r FROM n),
m AS (SELECT *, max(distance) OVER (PARTITION BY query_id, channel) AS dmax FROM r WHERE r <= 5),
sig AS (
  SELECT query_id, channel, avg(CASE WHEN r <= 3 THEN least(greatest(1 - distance * distance / 2, 0), 1) END) AS strength,
         avg(CASE WHEN dmax > 0 THEN 1 - distance / dmax ELSE 1 END) AS gradient FROM m GROUP BY query_id, channel)"""


def channel_signals(spark, d):
    out = fusion.channel_signals(_signals(spark, d), ["query_id"])
    return out.select("query_id", "channel", F.round("strength", 6).alias("strength"), F.round("gradient", 6).alias("gradient"))


def channel_weights(spark, d):
    near = Scratch(spark, "signals").write(_signals(spark, d, 1.3), "near")
    g = fusion.channel_signals(near, ["query_id"]).groupBy("query_id").agg(F.max(F.when(F.col("channel") == "code", F.col("gradient"))).alias("code_gradient"), F.max(F.when(F.col("channel") == "knowledge", F.col("gradient"))).alias("knowledge_gradient"))
    hits = near.groupBy("query_id").agg(*(F.sum(F.when(F.col("channel") == c, F.col("near")).otherwise(0)).alias(f"{c}_hits") for c in ("code", "knowledge")))
    out = fusion.detect_weights(g.join(hits, "query_id", "left").fillna(0, ["code_hits", "knowledge_hits"]))
    return out.select("query_id", F.round("code_weight", 6).alias("code_weight"), F.round("knowledge_weight", 6).alias("knowledge_weight"))


def hybrid_search(spark, d):
    """Batched hybrid search: benchmark items, each with the vector of the same number as its query vector."""
    v = A.read(spark, d, "embeddings").select(F.concat(F.lit("d:"), "vec_id").alias("id"), "embedding", "vec_id")
    queries = A.search_queries(spark, d).join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    out = search.search_many(search.Corpus(A.doc_texts(spark, d), A.edges(spark, d), v.select("id", "embedding")), queries)
    return out.select("query_id", "id", "channel", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def lexical_search(spark, d):
    """The same without models."""
    out = search.search_many(search.Corpus(A.doc_texts(spark, d), A.edges(spark, d)), A.search_queries(spark, d))
    return out.select("query_id", "id", "channel", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _sections(spark, d):
    corpus, (hits, *_) = _search(spark, d)
    return pack.sections(hits.select("query_id", "id", "rank"), corpus.entities)


def budget_fit(spark, d):
    out = pack.budget_fit(_sections(spark, d), 4096, ["query_id"])
    return out.select("query_id", "id", F.col("cost").cast("long").alias("cost"), "kept_cost", "truncated")


def pointer_index(spark, d):
    rows = _sections(spark, d)
    packed = pack.budget_fit(rows, 3000, ["query_id"]).where("not truncated")
    out = pack.pointer_index(rows, packed, 4096, ["query_id"])
    return out.select("query_id", "id", F.col("pointer_rank").cast("long").alias("pointer_rank"))


def context_pack(spark, d):
    """Sections of each query without repeats, within the budget, with headroom handed back."""
    rows = _sections(spark, d)
    tail = pack.compressed_tail(rows.withColumn("full_cost", F.col("cost")))
    kept = tail.join(pack.dedup_sections(tail).select("query_id", "id"), ["query_id", "id"])
    fit = pack.budget_fit(kept, 8192, ["query_id"]).where("not truncated")
    return pack.relaxed(fit, 8192).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "relaxed_cost")


_SECTIONS = ",\ns AS (SELECT h.query_id, h.id, h.rank, e.title, CAST(floor(length(e.title) / 4.0) + floor(length(e.content) / 4.0) AS BIGINT) AS cost FROM hits h JOIN ent e USING (id))"
_FIT = """
  SELECT *, total - cost AS before FROM (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS total FROM s)"""
_COVERAGE = r""",
wanted AS (SELECT * FROM qt WHERE length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN (""" + _STOP + r""")),
weighted AS (SELECT w.query_id, w.term, coalesce(df.df, 0) AS df, ln(greatest(n, 1) / greatest(coalesce(df.df, 0), 1)) AS idf FROM wanted w LEFT JOIN df USING (term), size),
body AS (SELECT h.query_id, lower(e.title || chr(10) || e.content) AS body FROM hits h JOIN ent e USING (id) WHERE rank <= 10),
found AS (SELECT DISTINCT w.query_id, w.term FROM weighted w JOIN body b ON w.query_id = b.query_id AND contains(b.body, w.term)),
part AS (SELECT w.query_id, sum(CASE WHEN w.df > 0 AND f.term IS NOT NULL THEN idf ELSE 0 END) AS got, sum(idf) AS total FROM weighted w LEFT JOIN found f ON w.query_id = f.query_id AND w.term = f.term GROUP BY w.query_id),
coverage AS (SELECT q.query_id, CASE WHEN total > 0 THEN got / total ELSE 1.0 END AS coverage FROM (SELECT DISTINCT query_id FROM qt) q LEFT JOIN part USING (query_id))"""

QUERIES = {f.__name__: f for f in (bm25_topk, doc_freq, prf_terms, answer_coverage, silence_gate, content_terms, search_terms, knn_topk, knn_filtered, knn_self_topk, near_duplicate_pairs, rrf_fuse, channel_merge, corroborated, first_emitter, expansion_cap, channel_signals, channel_weights, hybrid_search, lexical_search, budget_fit, pointer_index, context_pack)}

ORACLES = {
    "bm25_topk": f"WITH {A.BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM hits",
    "doc_freq": f"WITH {A.BM25} SELECT q.term, coalesce(df.df, 0) AS df FROM (SELECT DISTINCT term FROM qt) q LEFT JOIN df USING (term)",
    "prf_terms": f"""WITH {A.BM25},
        f AS (SELECT h.query_id, t.term, CAST(sum(3 * title_tf + content_tf) AS BIGINT) AS score, count(*) AS df FROM hits h JOIN tok t USING (id)
              WHERE h.rank <= 5 AND length(t.term) >= 4 AND NOT regexp_matches(t.term, '^[0-9]+$') AND t.term NOT IN ({_STOP}) GROUP BY h.query_id, t.term HAVING count(*) >= 2),
        g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = f.query_id AND qt.term = f.term))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank FROM g) WHERE rank <= 8""",
    "answer_coverage": f"WITH {A.BM25}{_COVERAGE} SELECT query_id, round(coverage, 6) AS coverage FROM coverage",
    "silence_gate": f"WITH {A.BM25}{_COVERAGE} SELECT h.query_id, count(*) AS hits FROM hits h JOIN coverage c USING (query_id) WHERE coverage >= 0.45 GROUP BY h.query_id",
    "content_terms": rf"""WITH {A.ENTITIES} SELECT id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(content, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g')), '[\p{{L}}\p{{N}}]+'),
        lambda t: length(t) >= 4 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP})))) AS BIGINT) AS terms FROM ent""",
    "knn_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q) SELECT id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (ORDER BY round(d, 9), id) AS rank FROM n) WHERE rank <= 10",
    "knn_filtered": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, q WHERE label < 5) SELECT id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (ORDER BY round(d, 9), id) AS rank FROM n) WHERE rank <= 10",
    "knn_self_topk": "WITH n AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT id, other, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), other) AS rank FROM n) WHERE rank <= 10",
    "near_duplicate_pairs": "SELECT a.vec_id AS id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35",
    "rrf_fuse": f"WITH {_LISTS} SELECT query_id, id, round(sum(CAST(weight AS DOUBLE) / (60 + rank)), 9) AS score FROM l GROUP BY query_id, id",
    "channel_merge": f"""WITH {_LISTS}, c AS (SELECT query_id, channel, id, sum(CAST(weight AS DOUBLE) / (60 + rank)) AS score FROM l GROUP BY query_id, channel, id),
        n AS (SELECT query_id, channel, id, score / max(score) OVER (PARTITION BY query_id, channel) * CASE channel WHEN 'code' THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS score FROM c)
        SELECT query_id, channel, id, round(score, 9) AS score FROM n WHERE score >= 0.2""",
    "corroborated": f"WITH {_LISTS} SELECT query_id, id, count(DISTINCT channel) AS channels FROM l WHERE rank > 10 GROUP BY query_id, id HAVING count(DISTINCT channel) >= 2",
    "first_emitter": f"WITH {_LISTS} SELECT query_id, id, channel AS kind, round(1.0::DOUBLE / rank, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY CASE channel WHEN 'knowledge' THEN 1 ELSE 2 END) AS p FROM l) WHERE p = 1",
    "expansion_cap": f"""WITH {_LISTS}, k AS (SELECT query_id, id, CASE channel WHEN 'code' THEN 'cochange' ELSE 'graph' END AS kind, 1.0::DOUBLE / rank AS score, rank FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY round(score, 9) DESC, id) AS r FROM k),
        c AS (SELECT *, sum(CASE WHEN kind = 'cochange' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS nc FROM r WHERE kind <> 'cochange' OR r <= 5),
        t AS (SELECT * FROM c WHERE kind = 'cochange' OR r <= 20 - nc)
        SELECT query_id, id, kind, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'cochange' THEN 1 ELSE 0 END, round(score, 9) DESC, id) AS rank FROM t""",
    "channel_signals": f"WITH {_SIGNALS} SELECT query_id, channel, round(strength, 6) AS strength, round(gradient, 6) AS gradient FROM sig",
    "channel_weights": f"""WITH {_SIGNALS}, g AS (SELECT query_id, max(CASE channel WHEN 'code' THEN gradient END) AS c, max(CASE channel WHEN 'knowledge' THEN gradient END) AS k FROM sig GROUP BY query_id),
        h AS (SELECT query_id, sqrt(count(*) FILTER (channel = 'code')) AS a, sqrt(count(*) FILTER (channel = 'knowledge')) AS b FROM n WHERE distance < 1.3 GROUP BY query_id),
        p AS (SELECT g.*, CASE WHEN coalesce(a, 0) + coalesce(b, 0) > 0 THEN coalesce(a, 0) / (coalesce(a, 0) + coalesce(b, 0)) ELSE 0.5 END AS pool FROM g LEFT JOIN h USING (query_id)),
        w AS (SELECT query_id, least(greatest(coalesce(((CASE WHEN c + k > 0 THEN c / (c + k) ELSE 0.5 END) + pool) / 2, pool), 0.2), 0.8) AS code FROM p)
        SELECT query_id, round(code, 6) AS code_weight, round(1 - code, 6) AS knowledge_weight FROM w""",
    "budget_fit": f"WITH {A.BM25}{_SECTIONS} SELECT query_id, id, cost, CAST(CASE WHEN total <= 4096 THEN cost WHEN cost = 0 THEN 0 ELSE 4096 - before END AS BIGINT) AS kept_cost, CASE WHEN total <= 4096 THEN cost WHEN cost = 0 THEN 0 ELSE 4096 - before END < cost AS truncated FROM ({_FIT}) WHERE before < 4096 OR cost = 0",
    "pointer_index": f"""WITH {A.BM25}{_SECTIONS}, fit AS ({_FIT}), packed AS (SELECT query_id, id, cost FROM fit WHERE total <= 3000 OR cost = 0),
        used AS (SELECT query_id, sum(cost) AS used FROM packed GROUP BY query_id),
        o AS (SELECT s.query_id, s.id, s.rank, CAST(floor(length('- ' || s.title) / 4.0) AS BIGINT) + 1 AS line_cost, coalesce(used, 0) AS used FROM s LEFT JOIN used USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM packed p WHERE p.query_id = s.query_id AND p.id = s.id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS k, sum(line_cost) OVER (PARTITION BY query_id ORDER BY rank, id ROWS UNBOUNDED PRECEDING) AS total FROM o)
        SELECT query_id, id, k AS pointer_rank FROM n WHERE k <= 25 AND total <= 4096 - used""",
}
