"""Deliveries, hit attribution and mining signals as functions of an ordered event log.

Events are (id, ts, actor, kind, key, returned): kind is one of open (a delivery of `key`), touch (a use of `key`), boundary
(closes the actor's deliveries), tool_ok, tool_error. All windows are partitioned by actor, so no step is global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.constants import DEFAULT

_ORDER = ("ts", "id")


def with_boundary(events: DataFrame, kinds: tuple[str, ...] = ("boundary",)) -> DataFrame:
    """Adds end_ts, end_id: the actor's next boundary after the event, if any."""
    after = Window.partitionBy("actor").orderBy(*_ORDER).rowsBetween(1, Window.unboundedFollowing)
    mark = F.when(F.col("kind").isin(*kinds), F.struct("ts", "id"))
    return events.withColumn("_end", F.first(mark, ignorenulls=True).over(after)).select("*", F.col("_end.ts").alias("end_ts"), F.col("_end.id").alias("end_id")).drop("_end")


def deliveries(events: DataFrame) -> DataFrame:
    """(delivery_id, actor, key, ts, closed, outcome): hit if the key is touched before the actor's next boundary, else miss once
    that boundary has come, else pending.

    Touches and openings are swept together: the next touch of the same key is a running minimum from below, so the
    interval join needs no join at all.
    """
    marked = with_boundary(events)
    later = Window.partitionBy("actor", "key").orderBy(*_ORDER).rowsBetween(1, Window.unboundedFollowing)
    touch = F.first(F.when(F.col("kind") == "touch", F.struct("ts", "id")), ignorenulls=True).over(later)
    opened = marked.withColumn("touch", touch).where("kind = 'open'")
    end = F.struct(F.col("end_ts").alias("ts"), F.col("end_id").alias("id"))
    hit = F.col("touch").isNotNull() & (F.col("end_id").isNull() | (F.col("touch") < end))
    outcome = F.when(hit, "hit").when(F.col("end_id").isNotNull(), "miss").otherwise("pending")
    return opened.select(F.col("id").alias("delivery_id"), "actor", "key", "ts", F.col("end_id").isNotNull().alias("closed"), outcome.alias("outcome"))


def usage_rates(usage: DataFrame, by: list[str]) -> DataFrame:
    """hits, misses, pending and rate per group."""
    hits, misses = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "miss")
    return usage.groupBy(*by).agg(hits.alias("hits"), misses.alias("misses"), F.count_if(F.col("outcome") == "pending").alias("pending")).withColumn("rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))))


def dead_weight(entities: DataFrame, usage: DataFrame, since=None) -> DataFrame:
    """Entities (id) never delivered, or not since a time."""
    used = usage if since is None else usage.where(F.col("ts") >= since)
    return entities.join(used.select(F.col("key").alias("id")).distinct(), "id", "left_anti")


def nth_latest(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n-th latest row of each group."""
    order = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == n)


def saves_after(events: DataFrame, anchor: str = "open") -> DataFrame:
    """(anchor_id, saves): distinct keys touched between an anchor event and the actor's next boundary."""
    run = F.sum((F.col("kind") == "boundary").cast("int")).over(Window.partitionBy("actor").orderBy(*_ORDER))
    staged = events.withColumn("stage", run)
    anchors = staged.where(F.col("kind") == anchor).select("actor", "stage", F.col("id").alias("anchor_id"), F.col("ts").alias("a_ts"))
    touches = staged.where("kind = 'touch'").select("actor", "stage", "id", "ts", "key")
    met = anchors.join(touches, ["actor", "stage"]).where((F.col("ts") > F.col("a_ts")) | ((F.col("ts") == F.col("a_ts")) & (F.col("id") > F.col("anchor_id"))))
    return met.groupBy("anchor_id", "actor").agg(F.countDistinct("key").alias("saves"))


def search_misses(events: DataFrame) -> DataFrame:
    """Empty searches (returned = 0) that saves followed."""
    empty = events.where((F.col("kind") == "open") & (F.col("returned") == 0)).select(F.col("id").alias("anchor_id"))
    return saves_after(events).join(empty, "anchor_id", "left_semi")


def uncharted_edits(events: DataFrame) -> DataFrame:
    """Deliveries without a hit that edits followed."""
    barren = deliveries(events).where("outcome <> 'hit'").select(F.col("delivery_id").alias("anchor_id"))
    return saves_after(events).join(barren, "anchor_id", "left_semi")


def recurring_use(usage: DataFrame, cfg=DEFAULT) -> DataFrame:
    return usage.where("outcome = 'hit'").groupBy("key").agg(F.count("*").alias("hits")).where(F.col("hits") >= cfg.hits_at_least)


def hot_keys(events: DataFrame, cfg=DEFAULT) -> DataFrame:
    """Keys saved often, on several days."""
    saves = events.where("kind = 'touch'").groupBy("key").agg(F.count("*").alias("saves"), F.countDistinct(F.to_date("ts")).alias("days"))
    return saves.where((F.col("saves") >= cfg.saves_at_least) & (F.col("days") >= cfg.save_days_at_least))


def error_fixes(events: DataFrame, cfg=DEFAULT) -> DataFrame:
    """(error_id, fix_id, distance): each failed tool call's first success of the same tool within the actor's next calls.

    A running minimum over the next calls of the tool finds it; the position tells whether it lies in the window.
    """
    calls = events.where(F.col("kind").isin("tool_ok", "tool_error"))
    numbered = calls.withColumn("pos", F.row_number().over(Window.partitionBy("actor").orderBy(*_ORDER)))
    later = Window.partitionBy("actor", "tool").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    fix = F.first(F.when(F.col("kind") == "tool_ok", F.struct("pos", "id")), ignorenulls=True).over(later)
    found = numbered.withColumn("fix", fix).where("kind = 'tool_error'").withColumn("distance", F.col("fix.pos") - F.col("pos"))
    return found.where(F.col("distance") <= cfg.fix_window).select(F.col("id").alias("error_id"), F.col("fix.id").alias("fix_id"), "distance")


def retained(events: DataFrame, as_of, cfg=DEFAULT) -> DataFrame:
    """Events no older than the retention period."""
    return events.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {cfg.retention_days} DAYS"))


def merge_patch(payload, patch):
    """A JSON object of string values with another's keys laid over it."""
    kind = "map<string,string>"
    return F.to_json(F.map_concat(F.map_filter(F.from_json(payload, kind), lambda k, _: ~F.array_contains(F.map_keys(F.from_json(patch, kind)), k)), F.from_json(patch, kind)))


def suggestions(signals: DataFrame, shown: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Signals (fingerprint, ...) that were not shown in the last hours; shown: fingerprint, ts."""
    recent = shown.where(F.col("ts") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")).select("fingerprint").distinct()
    return signals.join(recent, "fingerprint", "left_anti")


def touched_in_text(prompts: DataFrame, pending: DataFrame) -> DataFrame:
    """(prompt_id, id): pending entities (id, title) whose path appears as a token of a prompt, or whose title does.

    Titles meet prompts on their first token instead of pairwise; containment is checked afterwards.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    heads = prompts.select("prompt_id", "text", F.explode(F.array_distinct(words)).alias("head"))
    keyed = pending.where(F.length("title") >= 8).withColumn("head", F.regexp_extract(F.lower("title"), r"[\p{L}\p{N}]+", 0))
    return heads.join(keyed, "head").where(F.col("text").contains(F.col("title"))).select("prompt_id", "id").distinct()
