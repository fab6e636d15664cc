"""Structured Streaming twins of the usage log: retention, windows, suppression, and delivery outcomes with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOMES = "delivery_id long, actor long, key long, outcome string"
_STATE = "ids array<bigint>, keys array<bigint>"


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per hour and kind; later events than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("actor", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def once_a_day(suggestions: DataFrame) -> DataFrame:
    """Suggestions whose fingerprint has not come within 24 hours."""
    return suggestions.withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(["fingerprint"])


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, keys = (list(x) for x in state.get) if state.exists else ([], [])
    rows = pd.concat(list(batches)).sort_values(["ts", "id"])
    out = []
    for r in rows.itertuples():
        if r.kind == "open":
            ids.append(r.id)
            keys.append(r.key)
        elif r.kind == "touch":
            out += [(i, key[0], k, "hit") for i, k in zip(ids, keys) if k == r.key]
            kept = [(i, k) for i, k in zip(ids, keys) if k != r.key]
            ids, keys = [i for i, _ in kept], [k for _, k in kept]
        elif r.kind == "boundary":
            out += [(i, key[0], k, "miss") for i, k in zip(ids, keys)]
            ids, keys = [], []
    state.update((ids, keys))
    yield pd.DataFrame(out, columns=["delivery_id", "actor", "key", "outcome"])


def outcomes(events: DataFrame) -> DataFrame:
    """Hits and misses as they are decided; open deliveries are kept as the actor's state, pending ones are never emitted."""
    return events.select("actor", "id", "ts", "kind", "key").groupBy("actor").applyInPandasWithState(_step, OUTCOMES, _STATE, "append", GroupStateTimeout.NoTimeout)
