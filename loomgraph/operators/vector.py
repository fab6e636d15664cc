"""Vector search: nearest neighbours with filters, batches, near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.exprs import l2


def knn(vectors: DataFrame, query: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """(id, distance, rank): the k nearest by L2 to the one query vector (query: column q). Filters come before the cut.

    The query is one row, so it is broadcast; the cut is a top-k of each partition and a merge.
    """
    pool = vectors if keep is None else vectors.where(keep)
    near = pool.join(F.broadcast(query.limit(1).select("q"))).select("id", l2(F.col("embedding"), F.col("q")).alias("distance"))
    top = near.orderBy(F.round("distance", 9), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.round("distance", 9), "id")))


#: Rows of a block, elements of a matrix at once, groups up to which their sizes are broadcast, what rounding to 9 places may swap.
BLOCK, TILE, GROUPS, NEAR = 8192, 1 << 22, 100_000, 2e-9


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as a matrix padded with zeros, their lengths, and which are null or hold a null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten()
    row, width = np.repeat(np.arange(len(lists)), size), int(size.max(initial=0))
    missing = np.asarray(lists.is_null().to_numpy(zero_copy_only=False), bool).copy()
    if flat.null_count:
        missing[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        flat = flat.fill_null(0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == width).all():
        return values.reshape(len(lists), width), size, missing
    matrix = np.zeros((len(lists), width))
    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values
    return matrix, size, missing


def _distances(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L2 of columns a of x and b of y, summed in the order of the components as l2() does."""
    total = np.zeros(len(a))
    for t in range(min(len(x), len(y))):
        d = x[t][a] - y[t][b]
        total += d * d
    return np.sqrt(total)


def _firsts(row: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal values."""
    at = np.arange(len(row))
    start = np.ones(len(row), bool)
    start[1:] = row[1:] != row[:-1]
    return at - np.maximum.accumulate(np.where(start, at, 0))


def _cell(k: int, radius: float | None, apart: bool):
    """The candidates of a cell that may be among the k nearest of each query, and how many lie within the radius.

    Matrix products only choose candidates, within the bounds of their error; distances and ties are computed on the vectors.
    Of equal vectors those with the k smallest ids are enough. Vectors with nulls, of odd length or not finite are compared one by one.
    """
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, x_size, x_null = _vectors(left["e"])
        y, y_size, y_null = _vectors(right["e"])
        q_id, c_id = (np.array(t["id"].to_pylist()) if pa.types.is_string(t["id"].type) else t["id"].to_numpy() for t in (left, right))
        parts = []
        if len(q_id) and len(c_id):
            width = int(np.bincount(y_size).argmax())
            with np.errstate(all="ignore"):
                xx, yy = (x * x).sum(1), (y * y).sum(1)
            x_ok, y_ok = (~n & (s == width) & (v < 1e200) for n, s, v in ((x_null, x_size, xx), (y_null, y_size, yy)))
            order = np.argsort(c_id, kind="stable")
            place = np.empty(len(c_id), np.int64)
            place[order] = np.arange(len(c_id))
            most = k  # the query itself is left out at the end, as often as its id is there
            if apart:
                names, n = np.unique(c_id, return_counts=True)
                most += int(n[np.isin(names, q_id)].max(initial=0))
            good = order[y_ok[order]]
            if len(good) > most:  # of equal vectors, the first by id
                same = np.ascontiguousarray(y[good]).view(np.dtype((np.void, y.shape[1] * 8))).ravel() if y.shape[1] else np.zeros(len(good))
                kind = np.unique(same, return_inverse=True)[1].ravel()
                by = np.argsort(kind, kind="stable")
                good = np.sort(good[by[_firsts(kind[by]) < most]])
            xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
            all_good, odd = np.flatnonzero(y_ok), np.flatnonzero(~y_ok)
            slack = (width + 8) * 4.5e-16
            step = max(1, TILE // len(c_id))
            for lo in range(0, len(q_id), step):
                mine = np.arange(lo, min(lo + step, len(q_id)))
                sure, rest = mine[x_ok[mine]], mine[~x_ok[mine]]
                found, within = [], np.zeros(len(mine), np.int64)
                # what has no finite distance or is of another length
                for a, b in ((np.repeat(sure, len(odd)), np.tile(odd, len(sure))), (np.repeat(rest, len(c_id)), np.tile(np.arange(len(c_id)), len(rest)))):
                    if len(a):
                        with np.errstate(all="ignore"):
                            d = _distances(xt, yt, a, b)
                        null = x_null[a] | y_null[b] | (x_size[a] != y_size[b])
                        found.append((a, b, d, null))
                        if radius is not None:
                            within += np.bincount(a[(d < radius) & ~null & ((q_id[a] != c_id[b]) if apart else True)] - lo, minlength=len(mine))
                if len(sure) and len(all_good):
                    wide = good if radius is None else all_good
                    d2 = xx[sure][:, None] + yy[wide][None, :] - 2 * (x[sure][:, :width] @ y[wide][:, :width].T)
                    error = slack * (xx[sure] + yy[wide].max())
                    if radius is not None:
                        edge = radius * radius
                        n = (d2 < (edge - error)[:, None]).sum(1)
                        a, b = np.nonzero((d2 >= (edge - error)[:, None]) & (d2 <= (edge + error)[:, None]))
                        n += np.bincount(a[_distances(xt, yt, sure[a], wide[b]) < radius], minlength=len(sure))
                        if apart:  # the query itself
                            a, b = np.nonzero(q_id[sure][:, None] == c_id[wide][None, :]) if np.isin(c_id, q_id[sure]).any() else (np.array([], int), np.array([], int))
                            n -= np.bincount(a[_distances(xt, yt, sure[a], wide[b]) < radius], minlength=len(sure))
                        within[sure - lo] += n
                        if len(good) < len(wide):
                            d2 = d2[:, np.searchsorted(wide, good)]
                    bound = lambda v: (np.sqrt(np.maximum(v + error, 0)) + NEAR) ** 2 + error
                    if len(good) > most:
                        head = d2[:, : max(1024, 8 * most)]
                        a, b = np.nonzero(d2 <= bound(np.partition(head, most - 1, axis=1)[:, most - 1])[:, None])
                        v = d2[a, b]
                        by = np.lexsort((v, a))
                        a, b, v = a[by], b[by], v[by]
                        keep = v <= bound(v[_firsts(a) == most - 1])[a]
                        a, b = a[keep], b[keep]
                    else:
                        a, b = (z.ravel() for z in np.indices(d2.shape))
                    a, b = sure[a], good[b]
                    found.append((a, b, _distances(xt, yt, a, b), np.zeros(len(a), bool)))
                a, b, d, null = (np.concatenate(z) for z in zip(*found)) if found else [np.array([], int)] * 4
                if apart:
                    keep = q_id[a] != c_id[b]
                    a, b, d, null = a[keep], b[keep], d[keep], null[keep]
                d = np.where(null, np.nan, d)
                by = np.lexsort((place[b], d, null, a))
                a, b, d, null = a[by], b[by], d[by], null[by]
                at = _firsts(a)
                last = np.full(len(q_id), np.nan)
                last[a[at == k - 1]] = d[at == k - 1]
                tied = np.ones(len(a), bool)
                tied[1:] = (a[1:] != a[:-1]) | ~(d[1:] == d[:-1])
                run_at = np.arange(len(a)) - np.maximum.accumulate(np.where(tied, np.arange(len(a)), 0))
                keep = (at < k) | (d <= last[a] + NEAR) & (run_at < k)
                a, b, d, null = a[keep], b[keep], d[keep], null[keep]
                parts.append((a, b, pa.array(d, mask=null.astype(bool)), np.where(_firsts(a) == 0, within[a - lo], 0)))
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.array([], int) for i in (0, 1))
        distance = pa.concat_arrays([p[2] for p in parts]) if parts else pa.array([], pa.float64())
        near = pa.array(np.concatenate([p[3] for p in parts]) if parts else [], pa.int64())
        g = pa.array([key[0].as_py()] * len(a), key[0].type)
        return pa.table([g, left["id"].take(pa.array(a)), right["id"].take(pa.array(b)), distance, near], names=["g", "id", "other", "distance", "near"])

    return run


def nearest(queries: DataFrame, pool: DataFrame, k: int, radius: float | None = None, apart: bool = False, rows: int = BLOCK) -> DataFrame:
    """(g, id, other, distance, near): of queries (g, id, e) and a pool (g, id, e), the rows of each block of the pool that may
    be among the k nearest of a query of the same group g: its k nearest, and what rounding could put before them. near sums to how
    many of the pool lie within the radius. apart: not those of the query's own id. Without a distance (nulls, lengths): null, at the end.

    Blocks of about `rows` vectors meet once each in a grid of cells dealt by the cell; what leaves a cell is k rows a query.
    """
    a, b = (df.where("g is not null and id is not null").select("g", "id", "e").toDF("g", "id", "e") for df in (queries, pool))
    blocks = lambda df, name: df.groupBy("g").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = blocks(a, "nq").join(blocks(b, "nc"), "g")
    n = sizes.agg(F.count("*").alias("groups"), F.sum(F.col("nq").cast("long") * F.col("nc")).alias("cells")).first()
    sizes = F.broadcast(sizes) if n.groups <= GROUPS else sizes
    deal = lambda df, own, i, other, j: df.join(sizes, "g").withColumn(i, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*(F.col(c).alias(c) for c in ("g", "i", "j", "id", "e"))).repartition(max(1, min(2 * (n.cells or 0), 1000)), "g", "i", "j")
    left, right = deal(a, "nq", "i", "nc", "j"), deal(b, "nc", "j", "nq", "i")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"g {kind(a, 'g')}, id {kind(a, 'id')}, other {kind(b, 'id')}, distance double, near long"
    return left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(_cell(k, radius, apart), schema)


def knn_self(vectors: DataFrame, k: int, rows: int = BLOCK) -> DataFrame:
    """(id, other, distance, rank): the k nearest rows of the same type of each row; vectors: id, type, embedding."""
    v = vectors.select(F.col("type").alias("g"), "id", F.col("embedding").alias("e"))
    near = nearest(v, v, k, apart=True, rows=rows).select("id", "other", "distance")
    order = Window.partitionBy("id").orderBy(F.round("distance", 9).asc_nulls_last(), "other")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_cosines(threshold: float):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        if not len(both):
            return
        v, size, missing = _vectors(both["e"])
        if (size != size[0]).any():
            raise ValueError("vectors of different lengths")
        v[missing] = np.nan
        norm = np.sqrt((v * v).sum(1))
        v /= np.where(norm > 0, norm, 1)[:, None]
        kind = both["id"].type
        ids = np.array(both["id"].to_pylist()) if pa.types.is_string(kind) else both["id"].to_numpy()
        side = both["side"].to_numpy()
        same = key[0] == key[1]
        x, y = (np.flatnonzero(np.ones(len(side), bool) if same else side == k) for k in (0, 1))
        step = max(1, TILE // max(1, len(y)))
        for lo in range(0, len(x), step):
            rows = x[lo : lo + step]
            s = v[rows] @ v[y].T
            i, j = np.nonzero(s > threshold)
            x_id, y_id, s = ids[rows[i]], ids[y[j]], s[i, j]
            if same:
                keep = x_id < y_id
                x_id, y_id, s = x_id[keep], y_id[keep], s[keep]
            less = x_id < y_id
            yield pa.record_batch([pa.array(np.where(less, x_id, y_id), kind), pa.array(np.where(less, y_id, x_id), kind), pa.array(s)], names=["id", "other", "similarity"])

    return run


def near_pairs(vectors: DataFrame, threshold: float, rows: int = BLOCK) -> DataFrame:
    """(id, other, similarity) of all pairs id < other with a cosine above the threshold; ids are unique, vectors of one length.

    Blocks of about `rows` vectors meet once each in a grid of cells dealt by the cell. A worker has one cell, as numbers of
    Arrow, and a strip of its matrix product at a time, whose pairs leave before the next.
    """
    found = vectors.where("id is not null and embedding is not null").select("id", F.col("embedding").alias("e"))
    count = found.count()
    n = max(1, -(-count // rows), min(8, -(-count // 1024)))
    block = found.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # block b is on the left of the cells (b, b) to (b, n - 1), and on the right of (0, b) to (b - 1, b)
    cell = F.when(F.col("k") < F.col("b"), F.struct(F.col("k").alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"))).otherwise(F.struct(F.col("b").alias("i"), F.col("k").alias("j"), F.lit(0).alias("side")))
    dealt = block.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("c", cell).select("c.i", "c.j", "c.side", "id", "e").repartition(min(n * (n + 1), 1000), "i", "j")
    kind = vectors.schema["id"].dataType.simpleString()
    return dealt.groupBy("i", "j").applyInArrow(_block_cosines(threshold), f"id {kind}, other {kind}, similarity double")
