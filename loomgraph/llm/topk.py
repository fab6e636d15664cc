"""Exact top-k inner-product search by MaxScore over blocks of integer vectors.

A term is a component of the query; its score bounds in a block of candidates are the largest and the smallest
product with that component there. With the k-th best score known so far, the terms of the smallest ranges are
non-essential for a block when all of them together cannot lift a candidate to it from the block's base. A part of a
block whose bounds all together stay below it is skipped. The columns of the essential terms are traversed for all its
candidates; the other terms are probed a few at a time, the widest first, only for the candidates whose score so far
and remaining bounds stay competitive. No term is multiplied for a candidate that has dropped out. The results of the blocks are merged by a window with a map-side group limit.

Query blocks meet candidate blocks by an equi-join on (query block, candidate block): each pair of blocks is one
row, so any task holds one pair at a time. Only the numbers of blocks reach the driver.

Defined results: vectors that are null or empty or hold null or non-finite components take no part, nor do rows
without an id; vectors meet only vectors of the same length; all rows with the query's id are its own; repeated
queries give repeated results; fewer than k candidates give as many rows; scores beyond a long are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import Scratch

ROWS, STEP, PROBE = 4096, 1024, 4  # rows of a block; of a part with bounds of its own; terms probed between two looks at the bounds
_BLOCKS = "part int, seq int, dim int, ids binary, data binary"


def quantised(df: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as doubles holding whole numbers; unusable vectors are gone."""
    x = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(finite).select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}

    def row(dim: int, rows: list) -> pa.RecordBatch:
        nonlocal seq
        seq += 1
        values = [[part], [seq - 1], [dim], [np.array([i for i, _ in rows], "<i8").tobytes()], [np.array([v for _, v in rows], "<f8").tobytes()]]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "seq", "dim", "ids", "data"])

    for batch in batches:
        lists = batch.column(1)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k, vec_id in enumerate(batch.column(0).to_pylist()):
            v = flat[offsets[k] : offsets[k + 1]]
            rows = held.setdefault(len(v), [])
            rows.append((vec_id, v))
            if len(rows) == ROWS:
                yield row(len(v), held.pop(len(v)))
    for dim, rows in held.items():
        yield row(dim, rows)


class _Best:
    """The k best (score desc, id asc) of each query of a block, and the k-th score as threshold."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q = np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.id = np.empty(0, np.int64)
        self.threshold = np.full(queries, -np.inf)
        self.products = 0  # multiplications so far

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        kth = rank == self.k - 1
        self.threshold[q[kth]] = score[kth]
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]


def max_score(best: _Best, Q: np.ndarray, qids: np.ndarray, X: np.ndarray, xids: np.ndarray) -> None:
    """Add a candidate block to the best of a query block."""
    exact = float(np.abs(Q).max(initial=0)) * float(np.abs(X).max(initial=0)) * X.shape[1] < 2.0**53
    if not exact:  # beyond doubles: whole numbers of any size
        for i in range(len(Q)):
            q = [int(v) for v in Q[i]]
            scores = [(-min(max(sum(a * int(b) for a, b in zip(q, x)), -(2**63)), 2**63 - 1), int(j)) for x, j in zip(X, xids) if j != qids[i]]
            top = sorted(scores)[: best.k]
            best.add(np.full(len(top), i), np.array([-s for s, _ in top], object), np.array([j for _, j in top], np.int64))
        return
    for a in range(0, len(X), STEP):
        columns, ids = np.ascontiguousarray(X[a : a + STEP].T), xids[a : a + STEP]
        high, low = columns.max(1), columns.min(1)
        found = [_traverse(best, i, Q[i], columns, ids != qids[i], high, low) for i in range(len(Q))]
        at = np.concatenate([x for x, _ in found])
        best.add(np.repeat(np.arange(len(Q)), [len(x) for x, _ in found]), np.concatenate([x for _, x in found]), ids[at])


def _traverse(best: _Best, i: int, q: np.ndarray, columns: np.ndarray, others: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the candidates that may be among the best of query i, from the columns of the terms, a term at a time."""
    upper, lower = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    theta, span = best.threshold[i], upper - lower
    order = np.argsort(-span, kind="stable")
    # rest[m]: the most that all terms after the m widest add; without the essential ones a candidate stays below theta
    rest = np.append(np.cumsum(upper[order][::-1])[::-1], 0.0)
    base = np.append(0.0, np.cumsum(lower[order]))
    essential = int(np.argmax(base + rest < theta)) if (base + rest < theta).any() else len(q)
    if rest[0] < theta:
        return np.empty(0, np.int64), np.empty(0)  # no candidate can compete
    score = np.zeros(columns.shape[1])
    for t in order[:essential]:
        score += q[t] * columns[t]
    best.products += essential * len(score)
    at = np.nonzero(others)[0]
    if np.isinf(theta) and len(at) > best.k:  # no threshold yet: all terms are essential, and this block's k-th score is one
        theta = np.partition(score[at], len(at) - best.k)[len(at) - best.k]
    at = at[score[at] + rest[essential] >= theta]
    score = score[at]
    for m in range(essential, len(q), PROBE):
        if not len(at):
            break
        some = order[m : m + PROBE]
        for t in some:
            score += q[t] * columns[t, at]
        best.products += len(some) * len(at)
        keep = score + rest[m + len(some)] >= theta
        at, score = at[keep], score[keep]
    keep = score >= theta
    return at[keep], score[keep]


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # thresholds and results of the last query block of this task
        for batch in batches:
            for row in batch.to_pylist():
                qids, xids = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                if row["g"] not in held:
                    yield from (_results(g, *x) for g, x in held.items())
                    held = {row["g"]: (_Best(len(qids), k), qids)}
                Q = np.frombuffer(row["qdata"], "<f8").reshape(len(qids), row["dim"])
                max_score(held[row["g"]][0], Q, qids, np.frombuffer(row["data"], "<f8").reshape(len(xids), row["dim"]), xids)
        yield from (_results(g, *x) for g, x in held.items())

    return run


def _results(g: int, best: _Best, qids: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(best.q), g, np.int32)), pa.array(best.q, pa.int64()), pa.array(qids[best.q]), pa.array(best.id), pa.array([int(s) for s in best.score], pa.int64())], names=["g", "slot", "query_id", "vec_id", "score"])


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of a table (vec_id, v); queries are its rows where `is_query` holds."""
    scratch = Scratch(spark, "topk")
    queries = vectors.where(is_query)
    parts = max(1, queries.count() // ROWS)
    qblocks = scratch.write(queries.coalesce(parts).mapInArrow(_blocks, _BLOCKS), "queries")
    cblocks = scratch.write(vectors.mapInArrow(_blocks, _BLOCKS), "candidates")

    def numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
        counts = sorted((r.part, r.n) for r in blocks.groupBy("part").agg((F.max("seq") + 1).alias("n")).collect())  # one row per partition of blocks
        base, rows = 0, []
        for part, n in counts:
            rows.append((part, base))
            base += n
        bases = spark.createDataFrame(rows, "part int, base int")
        return blocks.join(bases, "part").withColumn(name, F.col("base") + F.col("seq")).drop("part", "seq", "base"), base

    left, n_left = numbered(qblocks.withColumnsRenamed({"ids": "qids", "data": "qdata"}), "g")
    right, n_right = numbered(cblocks, "c")
    if not n_left or not n_right:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    pairs = left.join(right, ["g", "c", "dim"]).sortWithinPartitions("g").select("g", "c", "dim", "qids", "qdata", "ids", "data")
    found = pairs.mapInArrow(_searcher(k), "g int, slot long, query_id long, vec_id long, score long")
    order = Window.partitionBy("g", "slot", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

