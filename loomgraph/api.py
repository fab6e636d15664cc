"""One facade over the engine's tables: typed calls in, DataFrames out, no hidden writes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.constants import DEFAULT, TRANSITIONS, Config
from loomgraph.functions.exprs import may_become, secret_kind
from loomgraph.operators import autolink, consolidate, graph, ingest, pack, search, usage


def check_limit(limit: int) -> int:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    return limit


def check_entity(title: str, content: str, tags: list[str] | None = None, confidence: float | None = None) -> None:
    if not title.strip() or len(title) > 200:
        raise ValueError("a title has 1 to 200 characters")
    if len(content.encode()) > 256 * 1024:
        raise ValueError("content is limited to 256 KiB")
    if tags and len(tags) > 32:
        raise ValueError("at most 32 tags")
    if confidence is not None and not 0 <= confidence <= 1:
        raise ValueError("confidence lies between 0 and 1")


@dataclass(frozen=True)
class Engine:
    """entities, edges, events; vectors and drift may be missing. Every writing call returns a new Engine."""

    spark: SparkSession
    entities: DataFrame
    edges: DataFrame
    events: DataFrame | None = None
    vectors: DataFrame | None = None
    drift: DataFrame | None = None
    config: Config = DEFAULT

    def _corpus(self) -> search.Corpus:
        return search.Corpus(self.entities, self.edges, self.vectors, self.drift)

    def create_entities(self, new: DataFrame) -> tuple[Engine, DataFrame]:
        """The engine with the new rows, and the refused ones with a reason: a secret (and its kind), an invalid title or content,
        or a status that may not follow the old one."""
        valid = (F.length(F.trim("title")) > 0) & (F.length("title") <= 200) & (F.octet_length("content") <= 256 * 1024)
        kind = F.when(valid, secret_kind(F.concat_ws("\n", "title", "content")))  # text of any size is not scanned
        reason = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(kind.isNotNull(), "secret")
        merged, illegal = ingest.upsert(self.entities, new.where(reason.isNull()))
        refused = new.where(reason.isNotNull()).select("id", kind.alias("secret"), reason.alias("reason"))
        return replace(self, entities=merged), refused.unionByName(illegal.select("id", F.lit(None).cast("string").alias("secret"), F.lit("status").alias("reason")))

    def set_status(self, ids: DataFrame, status: str) -> tuple[Engine, DataFrame]:
        """Entities with a new status where that is legal, and the ids where it is not."""
        if status not in TRANSITIONS:
            raise ValueError(f"unknown status {status}")
        hit = self.entities.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
        legal = F.col("_hit") & may_become(F.col("status"), F.lit(status))
        done = hit.withColumn("status", F.when(legal, status).otherwise(F.col("status"))).select(*self.entities.columns)
        return replace(self, entities=done), hit.where(F.col("_hit") & ~may_become(F.col("status"), F.lit(status))).select("id")

    def reject(self, ids: DataFrame) -> tuple[Engine, DataFrame]:
        return self.set_status(ids, "rejected")

    def query_entities(self, kind: str | None = None, status: str | None = None, file_path: str | None = None, references: str | None = None, limit: int = 50) -> DataFrame:
        """Conjunctive filters; status None means active, 'all' any; newest first, then id."""
        rows = self.entities
        if status != "all":
            rows = rows.where(F.col("status") == (status or "active"))
        if kind:
            rows = rows.where(F.col("type") == kind)
        if file_path:
            rows = rows.where(F.col("file_path") == file_path)
        if references:
            sources = self.edges.where((F.col("edge_type") == "references") & (F.col("target_id") == references)).select(F.col("source_id").alias("id"))
            rows = rows.join(sources, "id", "left_semi")
        return rows.orderBy(F.desc("created_at"), "id").limit(check_limit(limit))

    def list_entities(self, limit: int = 500) -> DataFrame:
        return self.entities.select("id", "title").orderBy("id").limit(check_limit(limit))

    def get_entities(self, ids: list[str]) -> DataFrame:
        """In the given order, each once, without those that are missing."""
        asked = self.spark.createDataFrame([(ids,)], "ids array<string>").select(F.posexplode("ids").alias("pos", "id")).groupBy("id").agg(F.min("pos").alias("pos"))
        return self.entities.join(F.broadcast(asked), "id").orderBy("pos").drop("pos")

    def search(self, queries: DataFrame, limit: int = DEFAULT.max_results) -> DataFrame:
        return search.search_many(self._corpus(), queries, check_limit(limit), self.config)

    def get_context(self, queries: DataFrame, budget: int = DEFAULT.task_budget) -> DataFrame:
        rows = pack.sections(self.search(queries).select("query_id", "id", "rank"), self.entities)
        kept = rows.join(pack.dedup_sections(rows).select("query_id", "id"), ["query_id", "id"])
        return pack.budget_fit(pack.compressed_tail(kept, self.config), budget, ["query_id"])

    def get_status(self) -> DataFrame:
        return self.entities.groupBy("type", "status").agg(F.count("*").alias("n"))

    def get_callers(self, ids: DataFrame) -> DataFrame:
        return graph.callers(self.edges, ids)

    def get_impact(self, ids: DataFrame, depth: int = 4) -> DataFrame:
        return graph.impact_set(self.edges, ids, min(depth, 4))

    def find_orphans(self) -> DataFrame:
        return graph.orphans(self.entities, self.edges)

    def consolidate(self) -> dict[str, DataFrame]:
        return {"duplicates": consolidate.title_duplicates(self.entities), "promotions": consolidate.promotion_candidates(self.entities, self.edges), "suspicious": consolidate.suspicious_rules(self.entities)}

    def auto_link(self) -> Engine:
        """Knowledge texts linked to the code they name; earlier automatic links are replaced."""
        kept = self.edges.where("edge_type <> 'auto_references'")
        links = autolink.auto_links(self.entities.where("type = 'knowledge'").select("id", "content"), self.entities).withColumn("weight", F.lit(1.0))
        return replace(self, edges=kept.unionByName(links.select(*kept.columns)))

    def capture_events(self, new: DataFrame) -> Engine:
        return replace(self, events=new if self.events is None else self.events.unionByName(new))

    def suggest_observations(self) -> dict[str, DataFrame]:
        return {"search_miss": usage.search_misses(self.events), "uncharted_edit": usage.uncharted_edits(self.events), "hot_keys": usage.hot_keys(self.events, self.config), "error_fix": usage.error_fixes(self.events, self.config)}
