"""Links from knowledge texts to the code they name, and what a saved file or a prompt refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import CODE_TYPES
from loomgraph.operators.graph import referencing

# Extensions by which a word of a prompt is a path.
PROMPT_EXTENSIONS = (".rs", ".py", ".go", ".js", ".jsx", ".ts", ".tsx", ".sh", ".md", ".toml", ".json")


def _mentions(texts: DataFrame) -> DataFrame:
    """(id, name, code): words of a text, and whether they stand in code: in backticks, called, or as a member."""
    word = r"[A-Za-z0-9_]+"
    every = lambda column, pattern, group=0: F.regexp_extract_all(column, F.lit(pattern), F.lit(group))
    text = F.col("content")
    ticked = F.concat_ws(" ", F.filter(F.split(text, "`"), lambda _, i: i % 2 == 1))
    plain = F.concat(every(text, word), every(text, rf"{word}(?:\.{word})+"))
    code = F.concat(every(ticked, word), every(text, rf"({word})\(", 1), every(text, rf"(?:::|\.)({word})", 1))
    both = F.concat(F.transform(F.array_distinct(plain), lambda w: F.struct(w.alias("name"), F.lit(False).alias("code"))), F.transform(F.array_distinct(code), lambda w: F.struct(w.alias("name"), F.lit(True).alias("code"))))
    return texts.select("id", F.explode(both).alias("m")).groupBy("id", "m.name").agg(F.bool_or("m.code").alias("code"))


def auto_links(texts: DataFrame, code: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type) from texts (id, content) to active code (id, type, title, file_path, status) that they name.

    Names must be unique. Identifier-shaped names (with _, . or camel case) count anywhere as whole words, single words only in
    code. File paths count as such. Words meet names by an equi-join, so texts and names never meet pairwise.
    """
    live = code.where((F.col("status") == "active") & F.col("type").isin(*CODE_TYPES))
    unique = live.where(F.length("title") >= 3).groupBy(F.col("title").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("target_id")).where("n = 1")
    shaped = F.col("name").rlike(r"[_.]|\p{Ll}\p{Lu}")
    named = _mentions(texts).join(unique, "name").where(shaped | F.col("code")).select(F.col("id").alias("source_id"), "target_id")
    paths = F.regexp_extract_all(F.col("content"), F.lit(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]*[A-Za-z0-9_])+"), F.lit(0))
    files = live.where("type = 'file'").select(F.col("file_path").alias("path"), F.col("id").alias("target_id"))
    pathed = texts.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(paths)).alias("path")).join(files, "path").select("source_id", "target_id")
    return named.unionByName(pathed).where("source_id <> target_id").distinct().withColumn("edge_type", F.lit("auto_references"))


def entities_for_path(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id): entities of exactly a path, or of one that ends with it. Paths meet on their last part."""
    last = F.regexp_extract("path", "([^/]+)$", 1)
    wanted = paths.select("path").distinct().withColumn("last", last)
    there = entities.where("file_path is not null").select("id", "file_path", F.regexp_extract("file_path", "([^/]+)$", 1).alias("last"))
    return wanted.join(there, "last").where((F.col("file_path") == F.col("path")) | F.col("file_path").endswith(F.col("path"))).select("path", "id")


def prompt_paths(prompts: DataFrame) -> DataFrame:
    """(prompt_id, path): words of a prompt that look like paths, with forward slashes."""
    words = F.split("text", r"[\s`\"'(),;]+")
    like = F.filter(words, lambda w: w.contains("/") | w.contains("\\") | w.rlike("(" + "|".join(e.replace(".", "[.]") for e in PROMPT_EXTENSIONS) + ")$"))
    return prompts.select("prompt_id", F.explode(F.array_distinct(F.transform(like, lambda w: F.translate(w, "\\", "/")))).alias("path"))


def scoped_rules(paths: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = 5, characters: int = 800) -> DataFrame:
    """(path, rule_id, content): the latest active rules that reference what lies on a saved path."""
    on_path = entities_for_path(entities, paths)
    rules = referencing(entities, edges, "rule").select(F.col("target_id").alias("id"), F.col("id").alias("rule_id"))
    found = on_path.join(rules, "id").select("path", "rule_id").distinct()
    text = F.when(F.length("content") > characters, F.concat(F.left("content", F.lit(characters)), F.lit("\n\n…"))).otherwise(F.col("content"))
    dated = found.join(entities.select(F.col("id").alias("rule_id"), "updated_at", text.alias("content")), "rule_id")
    order = Window.partitionBy("path").orderBy(F.desc("updated_at"), "rule_id")
    return dated.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("path", "rule_id", "content")
