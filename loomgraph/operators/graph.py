"""Graph queries over typed edges (source_id, target_id, edge_type, weight): breadth-first expansion, impact, orphans, links.

Hops are bounded. Discovery is by window functions with a total order, and all seeds move together. Visited nodes are
removed by anti-joins, never collected. Each hop's frontier is written to the shared folder, so that a later hop neither
repeats the earlier ones nor depends on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import CODE_TYPES, CURATED, DEFAULT, DEPENDENCY
from loomgraph.functions.exprs import edge_weight, is_test_path
from loomgraph.session import Scratch

#: Roots of an impact set up to which their names are broadcast.
ROOTS = 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations: node, neighbor, and the edge as stored."""
    columns = ["source_id", "target_id", "edge_type"]
    forward = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbor"), *columns)
    return forward.unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbor"), *columns))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, key: str = "seed") -> DataFrame:
    """(seed, id, depth): what each seed (seed, id) reaches in at most `hops` undirected steps, itself excluded."""
    both = undirected(edges).select("node", "neighbor").distinct()
    scratch = Scratch(edges.sparkSession, "hops")
    seen = frontier = scratch.write(seeds.select(key, "id", F.lit(0).alias("depth")), "0")
    for depth in range(1, hops + 1):
        reached = frontier.join(both, F.col("id") == F.col("node")).select(key, F.col("neighbor").alias("id")).distinct()
        frontier = scratch.write(reached.join(seen.select(key, "id"), [key, "id"], "left_anti").withColumn("depth", F.lit(depth)), str(depth))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def expand_paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth, seed, path, edge_path, score_weight): multi-seed expansion in which the first discovery claims a node.

    Within a hop, edges are taken by class weight (descending), source, target and type. The parent is the edge's source if
    that lies in the frontier. A node inherits its parent's seed and path.
    """
    both = undirected(edges).withColumn("w", edge_weight(F.col("edge_type")))
    start = seeds.select("id", F.lit(0).alias("depth"), F.col("id").alias("seed"), F.array("id").alias("path"), F.array().cast("array<string>").alias("edge_path"), F.lit(1.0).alias("weight")).dropDuplicates(["id"])
    scratch = Scratch(edges.sparkSession, "paths")
    seen = frontier = scratch.write(start, "0")
    for depth in range(1, hops + 1):
        met = frontier.join(both, F.col("id") == F.col("node")).join(seen.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        order = Window.partitionBy("neighbor").orderBy(F.desc("w"), "source_id", "target_id", "edge_type", (F.col("node") == F.col("source_id")).cast("int").desc())
        first = met.withColumn("r", F.row_number().over(order)).where("r = 1")
        found = first.select(F.col("neighbor").alias("id"), F.lit(depth).alias("depth"), "seed", F.concat("path", F.array("neighbor")).alias("path"), F.concat("edge_path", F.array("edge_type")).alias("edge_path"), (F.col("weight") * F.col("w")).alias("weight"))
        frontier = scratch.write(found, str(depth))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def graph_first(edges: DataFrame, seeds: DataFrame, cfg=DEFAULT) -> DataFrame:
    """(id, score, direct): curated neighbourhoods of weighted seeds (id, weight), a search of its own from every seed."""
    curated = undirected(edges.where(F.col("edge_type").isin(*CURATED))).withColumn("w", edge_weight(F.col("edge_type")))
    frontier = seeds.select(F.col("id").alias("seed"), "id", F.col("weight").alias("seed_weight"), F.lit(1.0).alias("path_weight"), F.lit(0).alias("hops"))
    seen = frontier
    for hop in range(1, cfg.graph_hops + 1):
        met = frontier.join(curated, F.col("id") == F.col("node")).join(seen.select("seed", F.col("id").alias("neighbor")), ["seed", "neighbor"], "left_anti")
        order = Window.partitionBy("seed", "neighbor").orderBy(F.desc("w"), "source_id", "target_id", "edge_type")
        first = met.withColumn("r", F.row_number().over(order)).where("r = 1")
        frontier = first.select("seed", F.col("neighbor").alias("id"), "seed_weight", (F.col("path_weight") * F.col("w")).alias("path_weight"), F.lit(hop).alias("hops"))
        seen = seen.unionByName(frontier)
    score = F.col("seed_weight") * F.pow(F.lit(cfg.hop_decay), F.col("hops")) * F.col("path_weight")
    found = seen.where("hops > 0").groupBy("id").agg(F.sum(score).alias("score"), F.bool_or(F.col("hops") == 1).alias("direct"))
    return found.where(F.col("score") >= cfg.graph_floor).join(seeds.select("id"), "id", "left_anti")


def seed_weights(ranked: DataFrame, cfg=DEFAULT) -> DataFrame:
    """(query_id, id, weight): 1 / (1 + rank0 / 20), the best over channels; the first seeds only."""
    best = ranked.groupBy("query_id", "id").agg(F.max(1 / (1 + (F.col("rank") - 1) / F.lit(20.0))).alias("weight"))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "id")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 3 * cfg.graph_max_seeds).drop("r")


def siblings(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sibling): what the files that contain an entity also contain, and the files themselves. Members are dealt by their file
    once, repeats are dropped and pairs are made there; pairs are dealt once more, by the entity, to drop others and repeats."""
    contains = edges.where("edge_type = 'contains'").select(F.col("source_id").alias("file"), F.col("target_id").alias("member")).repartition("file").distinct()
    mine = contains.select("file", F.col("member").alias("id"))
    pairs = mine.join(contains, "file").where("member <> id").select("id", F.col("member").alias("sibling"))
    both = pairs.union(mine.select("id", "file"))
    return both.join(members.select("id").distinct(), "id").distinct()  # a semi-join would go below the pairs


def cochange_candidates(cochange: DataFrame, terms: DataFrame, before: int, limit: int = 20) -> DataFrame:
    """(query_id, id, idf_sum, hits, score): entities whose past commits share terms; cochange: term, entity_id, commit_id, commit_ts."""
    past = cochange.where(F.col("commit_ts") < before).join(terms.select("term").distinct(), "term", "left_semi")
    df = past.groupBy("term").agg(F.countDistinct("commit_id").alias("df"))
    hits = past.join(df, "term").join(terms, "term").groupBy("query_id", F.col("entity_id").alias("id")).agg(F.sum(1 / F.col("df")).alias("idf_sum"), F.count("*").alias("hits"), F.countDistinct("term").alias("overlap"))
    score = 0.07 + 0.08 * F.col("idf_sum") / (F.col("idf_sum") + 3) + 0.05 * F.least("overlap", F.lit(3)) + 0.005 * F.least("hits", F.lit(8))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, caller, weight): sources of `calls` into an id."""
    calls = edges.where("edge_type = 'calls'").select(F.col("target_id").alias("id"), F.col("source_id").alias("caller"), "weight")
    return calls.join(ids, "id", "left_semi")


def impact_set(edges: DataFrame, ids: DataFrame, depth: int = 4, most: int = 1 << 20) -> DataFrame:
    """(root, id, depth, via_edge): what depends on each root, by least depth; ties take the least edge type.

    Roots travel as lists of numbers: a row for each edge and not for each root and edge, dealt by the entity that they reach, which drops what
    it has seen. Entities that more than `most` roots come to have no list; theirs are dealt one by one.
    """
    depends = edges.where(F.col("edge_type").isin(*DEPENDENCY)).select(F.col("target_id").alias("node"), F.col("source_id").alias("by"), "edge_type")
    scratch, kinds = Scratch(edges.sparkSession, "impact"), sorted(DEPENDENCY)
    placed = scratch.write(ids.select("id").where("id is not null").distinct().select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("m")), "placed")
    sizes, first, total = sorted((r.p, r.n) for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect()), {}, 0
    for p, n in sizes:
        first[p], total = total, total + n
    offset = F.create_map(*(F.lit(x) for p, n in first.items() for x in (p, n)))[F.col("p")] if first else F.lit(0)
    numbers = scratch.write(placed.select(F.col("id").alias("root"), (offset + F.col("m")).cast("int" if total < 1 << 31 else "long").alias("n")), "roots")
    seen = frontier = scratch.write(numbers.select(F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via_edge"), F.array("n").alias("roots")), "0")

    def lists(met: DataFrame, before: DataFrame) -> DataFrame:
        both = met.unionByName(before.select("id", F.lit(None).cast("string").alias("edge_type"), "roots"))
        of = lambda test: F.flatten(F.collect_list(F.when(test, F.col("roots"))))
        held = both.groupBy("id").agg(of(F.col("edge_type").isNull()).alias("old"), *(of(F.col("edge_type") == k).alias(f"by_{k}") for k in kinds))
        fresh = [F.struct(F.lit(k).alias("via_edge"), F.array_except(f"by_{k}", F.concat("old", *(f"by_{x}" for x in kinds[:i]))).alias("roots")) for i, k in enumerate(kinds)]
        return held.select("id", F.inline(F.array(*fresh))).where(F.size("roots") > 0)

    def singly(met: DataFrame, before: DataFrame) -> DataFrame:
        least = met.select("id", "edge_type", F.explode("roots").alias("root")).groupBy("root", "id").agg(F.min("edge_type").alias("via_edge"))
        fresh = least.join(before.select("id", F.explode("roots").alias("root")), ["root", "id"], "left_anti")
        return fresh.groupBy("id", "via_edge", F.pmod(F.xxhash64("root"), F.lit(1024)).alias("part")).agg(F.collect_list("root").alias("roots")).select("id", "via_edge", "roots")

    for d in range(1, depth + 1):
        met = frontier.select(F.col("id").alias("node"), "roots").join(depends, "node").select(F.col("by").alias("id"), "edge_type", "roots").where("id is not null")
        sizes = frontier.select(F.col("id").alias("node"), F.size("roots").alias("n")).join(depends, "node").groupBy(F.col("by").alias("id")).agg(F.sum("n").alias("n"))
        heavy = scratch.write(sizes.where(F.col("n") > most).select("id"), f"heavy{d}")
        if heavy.isEmpty():
            found = lists(met, seen)
        else:
            apart = lambda df, how: df.join(heavy, "id", how)
            found = lists(apart(met, "left_anti"), apart(seen, "left_anti")).unionByName(singly(apart(met, "left_semi"), apart(seen, "left_semi")))
        frontier = found.select("id", F.lit(d).alias("depth"), "via_edge", "roots")
        if d < depth:  # the last is read once
            frontier = scratch.write(frontier, str(d))
        seen = seen.unionByName(frontier)
    reached = seen.where("depth > 0").select(F.explode("roots").alias("n"), "id", "depth", "via_edge")
    return reached.join(F.broadcast(numbers) if total <= ROOTS else numbers, "n").select("root", "id", "depth", "via_edge")


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Active code entities that nothing depends on, tests excluded."""
    code = entities.where((F.col("status") == "active") & F.col("type").isin(*CODE_TYPES)).where(~is_test_path(F.col("file_path")))
    return code.join(edges.where(F.col("edge_type").isin(*DEPENDENCY)), F.col("id") == F.col("target_id"), "left_anti")


def referencing(entities: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(target_id, id): active entities of a type that reference a target."""
    links = edges.where(F.col("edge_type").isin("references", "auto_references")).select(F.col("source_id").alias("id"), "target_id").distinct()
    return entities.where((F.col("type") == kind) & (F.col("status") == "active")).select("id").join(links, "id").select("target_id", "id")


def references_map(edges: DataFrame) -> DataFrame:
    """(source_id, targets): sorted targets of each source's references."""
    return edges.where("edge_type = 'references'").groupBy("source_id").agg(F.array_sort(F.collect_set("target_id")).alias("targets"))


def describe_paths(paths: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds `description`: titles of the path joined by its edge types."""
    keyed = paths.withColumn("_key", F.concat_ws(">", "path", "edge_path"))
    named = keyed.select("_key", F.posexplode("path").alias("pos", "id")).distinct().join(titles.select("id", "title"), "id", "left")
    listed = named.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", "id").alias("t")))).alias("steps"))
    steps = F.transform("steps", lambda s: s["t"])
    edges = F.transform("edge_path", lambda e: F.concat(F.lit(" → "), F.replace(e, F.lit("_"), F.lit(" ")), F.lit(" → ")))
    text = F.array_join(F.zip_with(steps, F.concat(edges, F.array(F.lit(""))), lambda t, e: F.concat(t, e)), "")
    return keyed.join(listed, "_key").withColumn("description", text).drop("_key", "steps")


def name_map(entities: DataFrame) -> DataFrame:
    """(name, id) of names that only one entity has: qualified names, then last parts."""
    full = entities.select(F.col("qualified_name").alias("name"), "id").distinct()
    last = entities.select(F.regexp_extract("qualified_name", r"([^:.]+)$", 1).alias("name"), "id").where("name <> ''").distinct()
    unique = lambda df: df.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    first = unique(full)
    return first.withColumn("exact", F.lit(True)).unionByName(unique(last).join(first, "name", "left_anti").withColumn("exact", F.lit(False)))


def resolve_edges(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type) of raw edges (source_id, target_name, edge_type): the full name, else its last part."""
    names = name_map(entities)
    exact = names.select(F.col("name").alias("target_name"), F.col("id").alias("by_name"))
    last = names.select(F.col("name").alias("last"), F.col("id").alias("by_last"))
    joined = raw.withColumn("last", F.regexp_extract("target_name", r"([^:.]+)$", 1)).join(exact, "target_name", "left").join(last, "last", "left")
    found = joined.select("source_id", F.coalesce("by_name", "by_last").alias("target_id"), "edge_type")
    return found.where("target_id is not null and target_id <> source_id").distinct()


def contains_links(passages: DataFrame, texts: DataFrame, words: int = 3) -> DataFrame:
    """(passage_id, id): texts that contain a passage verbatim.

    Candidates meet on the rarest of the passage's `words`-word shingles instead of pairwise; containment is then checked.
    Passages too short for an inner shingle meet texts on their rarest run of three characters (or on all they have). Null and
    empty passages name nothing and are in no pair.
    """
    def grams(rows: DataFrame, column: str) -> DataFrame:
        cut = rows.withColumn("_w", F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        shifted = [F.slice("_w", k + 1, F.greatest(F.size("_w") - words + 1, F.lit(0))) for k in range(words)]
        joined = shifted[0]
        for other in shifted[1:]:
            joined = F.zip_with(joined, other, lambda a, b: F.concat_ws(" ", a, b))
        return cut.withColumn("g", F.array_distinct(joined)).drop("_w")

    # the first and last word of a passage may be parts of words in a text, so only inner shingles are keys
    own = grams(passages.select("passage_id", "passage"), "passage").withColumn("inner", F.slice("g", 2, F.greatest(F.size("g") - 2, F.lit(0))))
    keys = own.select("passage_id", F.explode("inner").alias("gram"))
    wanted = keys.select("gram").distinct()
    scratch = Scratch(texts.sparkSession, "links")
    met = grams(texts.select("id", "content"), "content").select("id", F.explode("g").alias("gram")).join(wanted, "gram", "left_semi")
    seen = scratch.write(met, "met")  # few of all shingles, and cutting the texts is most of the work
    df = seen.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("passage_id").orderBy("df", "gram")
    rarest = keys.join(df, "gram").withColumn("r", F.row_number().over(order)).where("r = 1").select("passage_id", "gram")
    pairs = rarest.join(seen, "gram").select("passage_id", "id").distinct()
    short = own.where((F.size("inner") == 0) & (F.length("passage") > 0)).select("passage_id", F.least(F.length("passage"), F.lit(3)).alias("size"), "passage")
    met = pairs
    for size in sorted(r.size for r in short.select("size").distinct().collect()):  # at most three lengths
        met = met.unionByName(_character_pairs(short.where(F.col("size") == size), texts, size))
    met = scratch.write(met, "pairs")  # so that Spark knows how few they are, and leaves the texts where they are
    return met.join(texts.select("id", "content"), "id").join(passages, "passage_id").where(F.col("content").contains(F.col("passage"))).select("passage_id", "id")


def _character_pairs(short: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(passage_id, id) of short passages and the texts that have their rarest run of `size` characters."""
    def runs(column: str):
        chars = F.split(column, "")
        joined = chars
        for k in range(1, size):
            joined = F.zip_with(joined, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.filter(joined, lambda r: r.isNotNull()))

    keys = short.select("passage_id", F.explode(runs("passage")).alias("run"))
    seen = texts.select("id", F.explode(runs("content")).alias("run")).join(keys.select("run").distinct(), "run", "left_semi")
    df = seen.groupBy("run").agg(F.count("*").alias("df"))
    order = Window.partitionBy("passage_id").orderBy("df", "run")
    rarest = keys.join(df, "run").withColumn("r", F.row_number().over(order)).where("r = 1").select("passage_id", "run")
    return rarest.join(seen, "run").select("passage_id", "id").distinct()
