"""Memory consolidation: duplicates, contradictions, promotion, merging, pruning, health checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import DEFAULT, RECORD_CATEGORIES
from loomgraph.functions.exprs import jaccard, lines_of, normal_title, suspicious
from loomgraph.session import Scratch


def title_duplicates(entities: DataFrame, threshold: float = DEFAULT.dedup_similarity) -> DataFrame:
    """(id, match_id, similarity, via): each entity's best earlier entity of the same type with the same title: equal in lower case
    (1.0, exact), or after normalisation (0.95, fuzzy). The join is on the normalised title; of several, the latest wins."""
    keyed = entities.where(F.col("title").isNotNull()).select("id", "type", F.lower("title").alias("low"), normal_title(F.col("title")).alias("key"), "created_at").where("key <> ''")
    order = Window.partitionBy("type", "key").orderBy("created_at", "id")
    exact = Window.partitionBy("type", "key", "low").orderBy("created_at", "id")
    marked = keyed.withColumn("same", F.lag("id").over(exact)).withColumn("near", F.lag("id").over(order))
    found = marked.where("near is not null").select("id", F.coalesce("same", "near").alias("match_id"), F.when(F.col("same").isNotNull(), 1.0).otherwise(0.95).alias("similarity"), F.when(F.col("same").isNotNull(), "exact").otherwise("fuzzy").alias("via"))
    return found.where(F.col("similarity") >= threshold)


def contradiction_pairs(pairs: DataFrame, entities: DataFrame, ratio: float = DEFAULT.contradiction_length_ratio) -> DataFrame:
    """Similar pairs (id, other, similarity) whose texts differ and are of like length."""
    text = entities.select("id", F.lower("content").alias("a"))
    joined = pairs.join(text, "id").join(text.select(F.col("id").alias("other"), F.col("a").alias("b")), "other")
    longer, shorter = F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))
    return joined.where((F.col("a") != F.col("b")) & (shorter > 0) & (longer <= ratio * shorter)).select("id", "other", "similarity", (longer / shorter).alias("ratio"))


# Units and their factors.
_TIME = {"ms": 0.001, "s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hour": 3600.0, "hours": 3600.0, "day": 86400.0, "days": 86400.0}
_SIZE = {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4}


def numeric_slots(text):
    """Numbers of a text with their unit class, canonical value and the words of three letters or more within 45 characters."""
    units = {**{k: ("time", v) for k, v in _TIME.items()}, **{k: ("size", v) for k, v in _SIZE.items()}, "%": ("%", 1.0)}
    factor = F.create_map(*(F.lit(x) for k, (_, v) in units.items() for x in (k, v)))
    kind = F.create_map(*(F.lit(x) for k, (c, _) in units.items() for x in (k, c)))
    pattern = r"(?<![\p{L}\p{N}.])[0-9]+(?:\.[0-9]+)?\s*(?:%|[A-Za-z]+)?"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def slot(z):
        m = z["m"]
        unit = F.lower(F.regexp_extract(m, r"(%|[A-Za-z]+)$", 1))
        near = F.concat_ws(" ", F.right(z["g"], F.lit(45)), F.left(z["n"], F.lit(45)))
        words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit(r"\p{L}+"), F.lit(0))), lambda w: F.length(w) > 2)
        value = F.regexp_extract(m, r"^[0-9]+(?:\.[0-9]+)?", 0).cast("double") * F.coalesce(factor[unit], F.lit(1.0))
        return F.struct(F.coalesce(kind[unit], unit).alias("class"), value.alias("value"), words.alias("words"))

    zipped = F.arrays_zip(found.alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("n"))
    return F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), slot)


def numeric_gate(pairs: DataFrame, entities: DataFrame, least: float = 0.65) -> DataFrame:
    """(id, other, decision): contradiction if both texts have a number of one class in like surroundings with different
    values, equivalent if the values agree."""
    slots = entities.select("id", numeric_slots(F.col("content")).alias("s"))
    joined = pairs.join(slots, "id").join(slots.select(F.col("id").alias("other"), F.col("s").alias("t")), "other")
    best = lambda differ: F.exists("s", lambda x: F.exists("t", lambda y: (x["class"] == y["class"]) & (F.size(x["words"]) > 0) & (jaccard(x["words"], y["words"]) >= least) & ((F.abs(x["value"] - y["value"]) > 1e-12) == F.lit(differ))))
    decision = F.when(best(True), "contradiction").when(best(False), "equivalent")
    return joined.select("id", "other", decision.alias("decision")).where("decision is not null")


def promotion_candidates(entities: DataFrame, edges: DataFrame, least: int = DEFAULT.promotion_supporters) -> DataFrame:
    """(id, supporters): active observations with enough supporters that no rule is derived from yet."""
    support = edges.where("edge_type = 'supports'").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("supporters")).where(F.col("supporters") >= least)
    promoted = edges.where("edge_type in ('derived_from', 'promoted_from')").select(F.col("target_id").alias("id"))
    return entities.where("type = 'observation' and status = 'active'").select("id").join(support, "id").join(promoted, "id", "left_anti")


def promote(entities: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New rules, their derived_from edges, and the sources' status changes."""
    source = entities.join(candidates, "id")
    rule = F.concat(F.lit("rule:"), F.col("id"))
    rules = source.select(rule.alias("id"), F.lit("rule").alias("type"), "title", "content", F.lit("active").alias("status"), F.lit(0.7).alias("confidence"))
    edges = source.select(rule.alias("source_id"), F.col("id").alias("target_id"), F.lit("derived_from").alias("edge_type"), F.lit(1.0).alias("weight"))
    return rules, edges, source.select("id", F.lit("superseded").alias("status"), rule.alias("superseded_by"))


def merge_plan(pairs: DataFrame, entities: DataFrame, most: int = 100_000) -> DataFrame:
    """(survivor, loser, similarity) in order of similarity: the earlier entity of a pair survives; a pair with an entity that
    is superseded already is skipped. The order matters, so each connected `block` is one sequential group of bounded size."""
    at = entities.select("id", "created_at")
    joined = pairs.join(at, "id").join(at.select(F.col("id").alias("other"), F.col("created_at").alias("other_at")), "other")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError("too many pairs in a block")
        gone, out = set(), []
        for r in rows.sort_values(["similarity", "id", "other"], ascending=[False, True, True]).itertuples():
            if r.id in gone or r.other in gone:
                continue
            keep, lose = (r.id, r.other) if (r.created_at, r.id) <= (r.other_at, r.other) else (r.other, r.id)
            gone.add(lose)
            out.append((r.block, keep, lose, r.similarity))
        return pd.DataFrame(out, columns=["block", "survivor", "loser", "similarity"])

    return joined.groupBy("block").applyInPandas(one, "block string, survivor string, loser string, similarity double")


def prune_candidates(entities: DataFrame, as_of, days: int = DEFAULT.prune_days) -> DataFrame:
    """Rejected or superseded observations with a file, older than some days."""
    age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400)
    return entities.where("type = 'observation' and status in ('rejected', 'superseded') and file_path is not null").withColumn("age_days", age).where(F.col("age_days") >= days)


def tombstones(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Pruned entities keep their row without title, content and hash."""
    hit = entities.join(ids.select("id").distinct().withColumn("_p", F.lit(True)), "id", "left")
    blank = {c: F.when(F.col("_p"), F.lit(None)).otherwise(F.col(c)) for c in ("title", "content_hash")}
    return hit.withColumns({**blank, "content": F.when(F.col("_p"), F.lit("")).otherwise(F.col("content")), "status": F.when(F.col("_p"), F.lit("pruned")).otherwise(F.col("status"))}).drop("_p")


def oldest_tombstones(entities: DataFrame, keep: int) -> DataFrame:
    """Pruned entities beyond the newest `keep`."""
    order = Window.partitionBy("status").orderBy(F.desc("created_at"), F.desc("id"))
    return entities.where("status = 'pruned'").withColumn("r", F.row_number().over(order)).where(F.col("r") > keep).drop("r")


def cascade_delete(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id")
    left = edges.join(gone, F.col("source_id") == F.col("id"), "left_anti").join(gone, F.col("target_id") == F.col("id"), "left_anti")
    return entities.join(gone, "id", "left_anti"), left


def line_jaccard(sections: DataFrame, least: float = DEFAULT.section_jaccard) -> DataFrame:
    """(group_id, id, other, similarity) of section pairs with like line sets (lines by 64-bit hashes, ids are unique).

    Pairs meet on lines that they must share: of a set's lines, rarest first, so many that a pair without one of them has too few in
    common; fewer for the smaller set of a pair. A pair is counted in the row where it first meets, so no pairs are kept or grouped;
    a line that most sections have is in few of these prefixes.
    """
    scratch, slack = Scratch(sections.sparkSession, "lines"), 1e-9
    hashed = F.transform(lines_of(F.col("content")), lambda line: F.xxhash64(line))
    sets = scratch.write(sections.select("group_id", "id", hashed.alias("s")).where(F.size("s") > 0), "sets")
    lines = sets.select("group_id", "id", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = lines.groupBy("group_id", "h").agg(F.count("*").alias("df")).where("df > 1")
    by_set = lines.join(often, ["group_id", "h"]).groupBy("group_id", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
    rare = F.col("n") - F.size("x")  # lines of this section alone come before the others
    prefix = lambda share: F.greatest(F.col("n") - F.ceil(share * F.col("n") - slack) + 1 - rare, F.lit(0)).cast("int")
    shared = scratch.write(by_set.select("group_id", "id", "n", rare.alias("u"), F.transform("x", lambda x: x["h"]).alias("s"), prefix(2 * least / (1 + least)).alias("few"), prefix(least).alias("many")).where("many > 0"), "shared")

    def side(name: str, length: str) -> DataFrame:
        first = shared.select("group_id", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "n", "u", "s")), F.slice("s", 1, F.col(length)).alias(f"{name}_p"))
        return first.select("*", F.posexplode(f"{name}_p").alias(f"{name}_at", "h"))

    met = side("a", "few").join(side("b", "many"), ["group_id", "h"])
    rest = lambda name: F.col(f"{name}_n") - F.col(f"{name}_u") - F.col(f"{name}_at")  # noqa: E731  of the line met and those after it
    enough = (F.col("a_n") >= least * F.col("b_n") - slack) & (F.least(rest("a"), rest("b")) >= least / (1 + least) * (F.col("a_n") + F.col("b_n")) - slack)
    found = met.where(((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_id") < F.col("b_id")))) & enough)
    once = found.where(F.get(F.array_intersect("a_p", "b_p"), F.lit(0)) == F.col("h"))
    both = once.withColumn("common", F.size(F.array_intersect("a_s", "b_s")))
    similarity = F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common"))
    return both.select("group_id", F.least("a_id", "b_id").alias("id"), F.greatest("a_id", "b_id").alias("other"), similarity.alias("similarity")).where(F.col("similarity") >= least)


def category_typos(categories: DataFrame, distance: int = 2, rare: int = 2, common: int = 3) -> DataFrame:
    """(category, likely): categories near a record category, or rare ones near common ones; categories: category, n.

    Words within an edit distance have lengths within it too, so they meet on the length.
    """
    records = categories.sparkSession.createDataFrame([(c,) for c in RECORD_CATEGORIES], "likely string")
    low = categories.select(F.lower("category").alias("category"), "n").groupBy("category").agg(F.sum("n").alias("n"))
    reach = F.explode(F.sequence(F.length("category") - distance, F.length("category") + distance))

    def near(rows: DataFrame, targets: DataFrame) -> DataFrame:
        met = rows.withColumn("_l", reach).join(targets.withColumn("_l", F.length("likely")), "_l")
        return met.where(F.levenshtein("category", "likely", distance).between(1, distance)).select("category", "likely")

    frequent = low.where(F.col("n") >= common).select(F.col("category").alias("likely"))
    return near(low, records).union(near(low.where(F.col("n") <= rare), frequent)).distinct()


def suspicious_rules(entities: DataFrame) -> DataFrame:
    return entities.where("type = 'rule' and status = 'active'").select("id", F.array_join(suspicious(F.col("content")), ", ").alias("markers")).where("markers <> ''")


def dimension_mismatches(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.size("embedding") != dim)


def corrupt_json(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull())


def file_problems(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, key): entities without their file, files without an entity, ids that several files declare."""
    missing = entities.where("file_path is not null and status <> 'pruned'").join(files, entities["file_path"] == files["path"], "left_anti").select(F.lit("missing_file").alias("kind"), F.col("id").alias("key"))
    unsynced = files.join(entities.select("file_path"), F.col("path") == F.col("file_path"), "left_anti").select(F.lit("unsynced_file").alias("kind"), F.col("path").alias("key"))
    double = files.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("kind"), F.col("id").alias("key"))
    return missing.union(unsynced).union(double)
