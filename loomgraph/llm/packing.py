"""Best-fit packing of documents into sequences, bulk-synchronously.

Pieces are range-sorted by length and ranked within their length, in parallel. Gaps are the free places of
open sequences, kept range-sorted by size as runs of consecutive sequences with the same gap. Each superstep
takes all unplaced pieces of one length, longest first, and sweeps them over their successors: the runs with the
smallest gap that holds them. All pieces of a length are alike, so a conflict over a gap is resolved by rank: the
pieces of ranks [a, b) get the sequences [c, c + b - a) of the run. The gaps are updated and the step repeats.
A superstep touches only runs, of which there are a few thousand at most whatever the corpus: lengths and gaps
are whole numbers up to the capacity, a length splits at most one run and adds at most two. The plan (length,
rank range -> sequence range, offset) is therefore bounded by the capacity, and each piece finds its place in it by
binary search on (length, rank).

Defined results: null texts are empty (a piece of the end id only); null and repeated doc_ids are packed like others.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import texts
from loomgraph.llm.tokens import default_tokenizer, encoder
from loomgraph.session import Scratch

CAPACITY = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def _cutter(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = enc.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if keep_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def cut_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    cut = texts(docs).mapInArrow(_cutter(tokenizer or default_tokenizer(), end_id, capacity, keep_ids), _PIECES)
    return cut if keep_ids else cut.drop("ids")


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) records: the supersteps over runs of gaps.

    counts: pieces of each length. Ranks of a record go up to the next record's of the same length.
    """
    gaps: list[int] = []  # sizes that have runs, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, sequences)
    plan, opened = [], 0

    def free(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):  # no successor: new sequences
                need = -(-(total - rank) // (capacity // length))
                free(capacity, opened, need)
                opened += need
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            used = min(n, total - rank)
            if used < n:
                free(gap, first + used, n - used)
            plan.append((length, rank, first, capacity - gap))
            free(gap - length, first, used)
            rank += used
    return plan


def _placer(plan: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0].astype(np.int64) * (1 << 45) + plan[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 45) + rank, "right") - 1
            kept = [k for k in range(len(names)) if names[k] not in ("rank", "part")]
            yield pa.record_batch([*(batch.column(k) for k in kept), pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], names=[*(names[k] for k in kept), "sequence_id", "offset"])

    return run


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece and length (1 to capacity)."""
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces, "pieces")  # encoded once; the range sort samples its input
    order = ["length", "doc_id", "piece"]
    sorted_ = scratch.write(cut.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sorted")
    sizes = sorted_.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_part = Window.partitionBy("part", "length").orderBy("doc_id", "piece")
    ranked = sorted_.withColumn("in_part", F.row_number().over(in_part) - 1).join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("in_part")).drop("base", "in_part")
    counts = {int(r.length): int(r.n) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length: at most `capacity`
    plan = np.array(sorted(plan_packing(counts, capacity)), np.int64).reshape(-1, 4)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("rank", "part"))
    return ranked.mapInArrow(_placer(plan), f"{kinds}, sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return pack_pieces(spark, cut_documents(docs, tokenizer, end_id, capacity, keep_ids), capacity)
