"""The registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from loomgraph.plans import graph_plans, lexical_plans, read_plans

QUERIES = {**lexical_plans.QUERIES, **graph_plans.QUERIES, **read_plans.QUERIES}
ORACLES = {**lexical_plans.ORACLES, **graph_plans.ORACLES, **read_plans.ORACLES}
FLAGSHIP = "bm25_topk"
