"""Information-theoretic sanitisation, in DataFrame operations only.

Base spans come from four patterns (leftmost, non-overlapping per kind, checked afterwards). Every distinct base value is a
protected entity e. Terms t of its texts (all words outside e-mail addresses) are weighed by what they disclose: PMI(e; t) =
log2(N c(e,t) / (c(e) c(t))) against the entity's own information log2(N / c(e)), with counts of documents over the whole
corpus. A term that carries at least the share GENERALISE of it is generalised (to its first letter and a mark), from
REMOVE on it is removed. A pair counts only if so many distinct texts with both are no coincidence: the bound
C(a, k) p^k on the chance that k of the entity's a texts have the term, p being the term's share of the texts, times the
number of entities and of words is at most ALPHA. Copies of a text are no evidence; a rarer entity needs a rarer term. Term
spans are added wherever such a term occurs as a whole word in the corpus.

Work is done once per distinct text that has anything to find; results are joined back to the documents. Flagged and
candidate terms are broadcast only below BROADCAST rows; beyond that all words are aggregated or joined by shuffles. Texts are picked
by the broadcast 64-bit hashes of up to a million keys; for more keys, texts are shuffled, of entities those with a digit or an @.

Defined results: null texts are empty and have no spans; repeated rows repeat; offsets are code points, end exclusive;
an empty table gives no rows; extra columns are ignored (find_spans) or kept (sanitise).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST as FEW
from loomgraph.llm.common import texts, unused
from loomgraph.session import Scratch

ALPHA, GENERALISE, REMOVE, BROADCAST = 0.01, 0.85, 0.95, 200_000
KINDS = ("email", "ip", "card", "phone", "term")

# The contract's patterns, written so that the engine never tries a start within a run of characters that has already
# failed, and never backtracks over or recurses on repeated parts: linear on texts of any length.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_ANY = "[0-9]|@"  # no base span is without
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def text_key(text: Column) -> Column:
    """96 bits that stand for a text."""
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.hash(text)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """The check digit rule; only for 14 to 19 digits."""
    reverse = F.split(F.reverse(_digits(match)), "")

    def weight(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(reverse, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    part = F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", "")
    ip = F.forall(F.split(part, r"\."), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    return F.when(kind == 1, ip).when(kind == 2, F.when(n.between(14, 19), _luhn(match)).otherwise(False)).when(kind == 3, n.between(10, 15)).otherwise(True)


def _placed(found: DataFrame) -> DataFrame:
    """Offsets of matches: rows (key, kind, pos, match, gap) -> with start and end. Running sums within a text."""
    upto = Window.partitionBy("key", "kind", "sub").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("match")).over(upto) - F.length("match")
    return found.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.length("match")).cast("long"))


def _found(text: Column, kind: int) -> Column:
    """An array of (gap before, match) of one kind; empty without a match."""
    name = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0))
    gaps = F.split(text, PATTERNS[name], -1)
    zipped = F.arrays_zip(matches.alias("m"), gaps.alias("g"))  # not inside the lambda, which would split again for each match
    row = lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), z["m"].alias("match"), F.length(z["g"]).alias("gap"))
    none = F.array().cast("array<struct<kind:int,pos:int,match:string,gap:int>>")
    return F.when(text.rlike(_NEEDS[name]), F.filter(F.transform(zipped, row), lambda r: r["match"].isNotNull())).otherwise(none)


def base_spans(scratch: Scratch, keyed: DataFrame) -> DataFrame:
    """key, kind, match, start, end of every valid base span of each distinct text."""
    any_ = F.flatten(F.array(*(_found(F.col("text"), k) for k in range(4))))
    hit = keyed.where(F.col("text").rlike(_ANY)).select("key", F.explode(any_).alias("f"))
    rows = hit.select("key", "f.*").distinct().withColumn("sub", F.lit(""))
    spans = _placed(rows).where(_valid(F.col("kind"), F.col("match")))
    return scratch.write(spans.select("key", "kind", "match", "start", "end"), "base")


def _picked(scratch: Scratch, keyed: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of `keyed` to join with `keys` by key: only those with the hash of one, if the hashes are few enough to be sent to all
    executors. Spark's own size check would shuffle all the texts instead."""
    hashes = scratch.write(keys.select(F.xxhash64("key").alias("hash")).distinct(), name)
    if hashes.count() > FEW:
        return keyed
    return keyed.join(F.broadcast(hashes), F.xxhash64(keyed["key"]) == hashes["hash"], "left_semi")


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def disclosing_terms(scratch: Scratch, keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """term, share: the largest part of any entity's information that a term carries, if it is at least GENERALISE."""
    words = keyed.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    size = keyed.agg(F.count("*").alias("docs"), F.approx_count_distinct("key", 0.01).alias("texts")).first()
    entities = spans.select("key", F.concat_ws(":", "kind", F.lower("match")).alias("entity")).distinct()
    kinds = entities.agg(F.count_distinct("entity").alias("n")).first().n
    if kinds == 0:
        return scratch.write(spans.select(F.lit("").alias("term"), F.lit(0.0).alias("share")).where("false"), "flagged")
    n, distinct = size.docs, min(size.docs, size.texts)
    spare = math.log2(ALPHA) - math.log2(kinds) - math.log2(max(1, words.agg(F.approx_count_distinct("term", 0.01).alias("v")).first().v))
    least = math.ceil(spare / -math.log2(distinct)) if distinct > 1 else n + 1  # with fewer texts not even a term of theirs alone can count
    frequent = entities.groupBy("entity").agg(F.count("*").alias("a")).where(F.col("a") >= least)
    entities = scratch.write(entities.join(frequent, "entity"), "entities")
    likely = _picked(scratch, keyed.where(F.col("text").rlike(_ANY)), entities, "entity-hashes")
    some = scratch.write(likely.join(entities.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"), F.count("*").alias("docs")), "some")
    outside = F.array_distinct(_terms(F.regexp_replace("text", PATTERNS["email"], " ")))
    near = some.select("key", "docs", F.explode_outer(outside).alias("term"))
    counted = scratch.write(near.join(entities, "key"), "near")
    scratch.release()
    of_entity = counted.select("key", "entity", "docs").distinct().groupBy("entity").agg(F.sum("docs").alias("ce"))
    pairs = counted.where("term is not null").groupBy("entity", "term").agg(F.sum("docs").alias("cet"), F.count("*").alias("k"), F.any_value("a").alias("a")).where(F.col("k") >= least)
    # documents with the term near anything are some of those with the term: they bound its share from above
    anywhere = counted.where("term is not null").select("key", "term", "docs").distinct().groupBy("term").agg(F.sum("docs").alias("cn"))
    own = F.log2(F.lit(float(n)) / F.col("ce"))
    share = lambda ct: F.log2(F.lit(float(n)) * F.col("cet") / (F.col("ce") * F.col(ct))) / own
    likely = pairs.join(of_entity, "entity").join(anywhere, "term").where((own > 0) & (share("cn") >= GENERALISE))
    part = lambda x, y: F.when(x > 0, x * F.log2(y / x)).otherwise(0.0)
    choices = part(F.col("k"), F.col("a")) + part(F.col("a") - F.col("k"), F.col("a"))  # at least log2 C(a, k)
    pairs = scratch.write(likely.select("term", "cet", "ce", "k", choices.alias("choices")), "pairs")
    wanted = scratch.write(pairs.select("term").distinct(), "wanted")
    if wanted.count() <= BROADCAST:
        df = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("ct"))
    else:
        df = words.groupBy("term").agg(F.count("*").alias("ct"))
    chance = F.col("choices") + F.col("k") * F.log2(F.least(F.lit(1.0), F.col("ct") / F.lit(float(distinct))))
    flagged = pairs.join(df, "term").where(chance <= spare).withColumn("share", share("ct")).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= GENERALISE)
    return scratch.write(flagged, "flagged")


def term_spans(scratch: Scratch, keyed: DataFrame, flagged: DataFrame) -> DataFrame:
    """key, kind, match, start, end, share of all whole-word occurrences of flagged terms, once per distinct text."""
    words = keyed.select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    terms = F.broadcast(flagged) if flagged.count() <= BROADCAST else flagged
    hits = words.join(terms, "term").groupBy("key", "term").agg(F.max("share").alias("share"))
    hits = scratch.write(hits, "hits")
    where = scratch.write(hits.groupBy("key").agg(F.collect_list(F.struct("term", "share")).alias("terms")), "where")
    pattern = "concat('(?iu)(?<![\\\\p{L}])', t.term, '(?![\\\\p{L}])')"
    rows = _picked(scratch, keyed, where, "where-hashes").join(where, "key").groupBy("key", "terms").agg(F.any_value("text").alias("text")).select("key", "text", F.explode("terms").alias("t"))
    zipped = f"arrays_zip(regexp_extract_all(text, {pattern}, 0), transform(split(text, {pattern}, -1), g -> length(g)))"
    rows = rows.select("key", F.col("t.term").alias("sub"), F.col("t.share").alias("share"), F.lit(4).alias("kind"), F.expr(f"posexplode({zipped})").alias("pos", "z"))
    rows = rows.select("key", "sub", "share", "kind", "pos", F.col("z")["0"].alias("match"), F.col("z")["1"].alias("gap")).where("match is not null")
    return scratch.write(_placed(rows).select("key", "kind", "match", "start", "end", "share"), "terms")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("key", text_key(F.col("text")))


def all_spans(scratch: Scratch, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans and term spans of the distinct texts."""
    base = base_spans(scratch, keyed)
    scratch.release()
    flagged = disclosing_terms(scratch, keyed, base)
    scratch.release()
    terms = term_spans(scratch, keyed, flagged)
    scratch.release()
    return base, terms


def find_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    scratch = Scratch(spark, "pii")
    keyed = _keyed(docs)
    base, terms = all_spans(scratch, keyed)
    both = base.select("key", "kind", "start", "end").unionByName(terms.select("key", "kind", "start", "end"))
    span = F.struct("start", "kind", "end")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(5)]
    per_text = both.groupBy("key").agg(F.collect_list(F.when(F.col("kind") < 4, span)).alias("b"), F.collect_list(span).alias("a"), *counts)
    per_text = scratch.write(per_text.select("key", F.sha2(_joined(F.col("b")), 256).alias("base_sha256"), _joined(F.col("a")).alias("spans"), *(f"n_{k}" for k in KINDS)), "texts")
    joined = keyed.select("doc_id", "key").join(per_text, "key", "left")
    zero = {f"n_{k}": 0 for k in KINDS}
    return joined.fillna(zero).select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "n_term")


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with all their columns: base spans become their kind's label, terms are generalised or removed; n_chars,
    if there is one, is counted anew. Overlapping spans are replaced as one, by the first one's label."""
    scratch = Scratch(spark, "sanitise")
    keyed = _keyed(docs)
    base, terms = all_spans(scratch, keyed)
    names = F.array(*(F.lit(LABELS[k]) for k in KINDS[:4]))
    softened = F.when(F.col("share") >= REMOVE, F.lit("")).otherwise(F.concat(F.left("match", F.lit(1)), F.lit("*")))
    rows = base.select("key", "kind", "start", "end", names[F.col("kind")].alias("label")).unionByName(terms.select("key", "kind", "start", "end", softened.alias("label")))
    order = Window.partitionBy("key").orderBy("start", "kind", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(F.col("start") < F.coalesce(reach, F.lit(0)), 0).otherwise(1))
    run = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", F.struct("start", "kind", "end")).alias("label"))
    cuts = scratch.write(merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("cuts")), "cuts")
    scratch.release()
    key, cut = (unused(docs.columns, c) for c in ("pii_key", "pii_cuts"))
    marked = docs.withColumn(key, text_key(F.coalesce(docs["text"], F.lit(""))))
    joined = marked.join(cuts.withColumnsRenamed({"key": key, "cuts": cut}), key, "left")
    piece = f"transform({cut}, (c, i) -> concat(substring(text, cast(if(i = 0, 0, {cut}[i - 1].end) as int) + 1, cast(c.start - if(i = 0, 0, {cut}[i - 1].end) as int)), c.label))"
    tail = f"substring(text, cast(element_at({cut}, -1).end as int) + 1)"
    clean = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.expr(f"concat(array_join({piece}, ''), {tail})"))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
