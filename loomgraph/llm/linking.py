"""Exact similarity links between many sets, without all pairs of a group.

Input are postings (key, id), where sets that share a key may be similar, and members (id, n, sig), n being the set's size,
sig its SIG MinHash coordinates (32 bits each). A pair is a candidate only if enough of the coordinates collide. Links come in rounds:

1. each posting's members are compared with its pivot (its least id): as many comparisons as postings;
2. the connected components so far are computed by label propagation over written tables;
3. postings of three members or more (of two, the pivot has met the other) that still hold several components are cut
   into chunks; chunks meet pairwise unless both lie in one and the same component, and pairs with the pivot are done. Members of different components whose sizes and signatures still allow a link are compared on their
   full sets, as products of incidence matrices of two chunks. Only a spanning forest of a block's links leaves its task:
   at most one link a member, however many pairs are alike. A group that its pivots connect costs nothing here; a pair
   that could be linked is never dropped.

Full sets are rebuilt from the texts of the ids in question, never of all documents, and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Scratch

SIG, CHUNK, MASS = 64, 1024, 1 << 20


def bound(similarity: float, coordinates: int = SIG, deviations: float = 5.0) -> int:
    """Collisions that a linked pair has but for a chance of about 1e-6."""
    return int(coordinates * similarity - deviations * (coordinates * similarity * (1 - similarity)) ** 0.5)


def possible(n_a: np.ndarray, sig_a: np.ndarray, n_b: np.ndarray, sig_b: np.ndarray, percent: int, least: int) -> np.ndarray:
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & ((sig_a == sig_b).sum(-1) >= least)


def _pivot_filter(percent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, n, b, m = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
                s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 5))
                keep = pa.array(possible(n, s, m, t, percent, least))
                yield pa.record_batch([batch.column(0).filter(keep), batch.column(3).filter(keep)], names=["a", "b"])

    return run


def pivot_pairs(scratch: Scratch, postings: DataFrame, members: DataFrame, percent: int, least: int) -> DataFrame:
    """Distinct (a, b): pivot and member of a posting that may be linked. Joins start from written tables, so that
    Spark can split their hot keys."""
    pivots = scratch.write(postings.groupBy("key").agg(F.min("id").alias("p")), "pivots")
    pairs = scratch.write(postings.select("key", F.col("id").alias("b")).join(pivots, "key").where("p < b").select("p", "b").distinct(), "stars")
    left = members.select(F.col("id").alias("p"), F.col("n").alias("pn"), F.col("sig").alias("ps"))
    right = members.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("sig").alias("bs"))
    return pairs.join(left, "p").join(right, "b").select("p", "pn", "ps", "b", "bn", "bs").mapInArrow(_pivot_filter(percent, least), "a long, b long")


def _verifier(shingles: Callable[[str], np.ndarray], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last_id:
                    last_id, last = a, shingles(x.as_py())
                other = shingles(y.as_py())
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(last) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, items: DataFrame, shingles: Callable[[str], np.ndarray], percent: int) -> DataFrame:
    """The pairs (a, b) linked on their full sets; items (id, text) has the texts of all ids of the pairs."""
    x = items.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = items.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verifier(shingles, percent), "a long, b long")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, component): the least id reachable, for every id with a link.

    Least labels spread over links and labels are short-cut to their labels' labels until nothing changes; each round
    is a written table, so lineage stays short and a lost executor repeats one round at most.
    """
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    label = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("least", "id").alias("component")), f"{name}-0")
    k = 0
    while True:
        k += 1
        spread = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = label.join(spread, "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("far"))
        after = lower.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("component"), (F.col("component") != F.least("next", F.coalesce("far", "next"))).alias("changed"))
        written = scratch.write(after, f"{name}-{k}")
        done = written.where("changed").limit(1).count() == 0
        scratch.drop(f"{name}-{k - 1}")
        label = written.select("id", "component")
        if done:
            return label


def _met_before(keys_a: list, keys_b: list, key: int) -> np.ndarray:
    """Whether each pair also shares a posting of a smaller key, where it is looked at already."""
    columns: dict[int, int] = {}
    sides = []
    for lists in (keys_a, keys_b):
        at = [(i, columns.setdefault(k, len(columns))) for i, ks in enumerate(lists) for k in ks if k < key]
        sides.append((len(lists), np.array(at, np.int64).reshape(-1, 2)))
    incidence = []
    for n, at in sides:
        m = np.zeros((n, len(columns)), np.float32)
        m[at[:, 0], at[:, 1]] = 1
        incidence.append(m)
    return incidence[0] @ incidence[1].T > 0


class _Side:
    """One side of a batch of chunk pairs: the members of all rows in flat arrays."""

    def __init__(self, lists: pa.ListArray):
        self.ends, values = lists.offsets.to_numpy(), lists.values
        self.id, self.c, self.n = (values.field(k).to_numpy() for k in ("id", "c", "n"))
        self.sig = np.frombuffer(b"".join(values.field("sig").to_pylist()), "<u4").reshape(len(values), -1)
        self.keys = values.field("keys")


def _pairs_of(a: _Side, b: _Side, pivot: np.ndarray, percent: int, least: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, member of a, member of b) of the possible links between different components that no pivot has decided, some
    rows of the batch at a time."""
    na, nb = np.diff(a.ends).astype(np.int64), np.diff(b.ends).astype(np.int64)
    upto = np.cumsum(na * nb)
    at = 0
    while at < len(na):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        sizes = (na * nb)[at:to]
        row = np.repeat(np.arange(at, to), sizes)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x, y = a.ends[row] + within // nb[row], b.ends[row] + within % nb[row]
        ok = (a.c[x] != b.c[y]) & (a.id[x] != pivot[row]) & (b.id[y] != pivot[row])
        ok &= (100 * np.minimum(a.n[x], b.n[y]) >= percent * np.maximum(a.n[x], b.n[y]))
        row, x, y = row[ok], x[ok], y[ok]
        alike = [(a.sig[x[k : k + 16384]] == b.sig[y[k : k + 16384]]).sum(1) >= least for k in range(0, len(x), 16384)]
        alike = np.concatenate(alike) if alike else np.empty(0, bool)
        yield row[alike], x[alike], y[alike]
        at = to


def _candidates(percent: int, least: int):
    """Chunk pairs -> the members of either side that have a possible partner in another component."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    names = ["key", "i", "j", "ids_a", "c_a", "ids_b", "c_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _Side(batch.column("left")), _Side(batch.column("right"))
            key, i, j, pivot = (batch.column(k).to_numpy() for k in ("key", "i", "j", "pivot"))
            out: list[list] = [[] for _ in names]
            for row, x, y in _pairs_of(a, b, pivot, percent, least):
                for r, at in zip(*np.unique(row, return_index=True)):
                    to = np.searchsorted(row, r, "right")
                    (u, p), (v, q) = (np.unique(z[at:to], return_inverse=True) for z in (x, y))
                    met = _met_before(a.keys.take(pa.array(u)).to_pylist(), b.keys.take(pa.array(v)).to_pylist(), int(key[r]))
                    fresh = ~met[p, q]
                    if fresh.any():
                        u, v = u[np.unique(p[fresh])], v[np.unique(q[fresh])]
                        for column, value in zip(out, (key[r], i[r], j[r], a.id[u], a.c[u], b.id[v], b.c[v])):
                            column.append(value)
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted sets, all of a with all of b, as products of incidence matrices."""
    out = np.zeros((len(a), len(b)), np.float32)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    for at in range(0, len(shared), width):
        part = shared[at : at + width]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                inside = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                where = np.searchsorted(part, inside)
                m[i, where[part[where] == inside]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(i, j) of links that connect what all the links of a block connect. Rows and columns that share a component in `left`
    or `right` are one vertex, so no more links are chosen than there are components."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    rows, columns = at[: len(left)], at[len(left) :]
    of_row, of_column = ([np.nonzero(x == v)[0] for v in range(len(names))] for x in (rows, columns))
    open_ = np.ones(len(names), bool)
    chosen = []
    for root in range(len(names)):
        if not open_[root]:
            continue
        open_[root], todo = False, [root]
        while todo:
            v = todo.pop()
            for mine, other, links in ((of_row[v], columns, linked), (of_column[v], rows, linked.T)):
                for k in mine:
                    reached = np.nonzero(links[k] & open_[other])[0]
                    fresh, first = np.unique(other[reached], return_index=True)
                    chosen += [(int(k), int(m)) if links is linked else (int(m), int(k)) for m in reached[first]]
                    open_[fresh] = False
                    todo += fresh.tolist()
    return chosen


def _block_verifier(shingles: Callable[[str], np.ndarray], percent: int):
    """Blocks of members with texts -> a spanning forest of the links between their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                sides = [[m for m in row["members"] if m["side"] == k] for k in (0, 1)]
                sets = [[shingles(m["text"]) for m in side] for side in sides]
                if not sets[0] or not sets[1]:
                    continue
                both = overlaps(*sets)
                n, m = (np.array([len(s) for s in x]) for x in sets)
                (ids_a, c_a), (ids_b, c_b) = ((np.array([x["id"] for x in side]), np.array([x["c"] for x in side])) for side in sides)
                linked = (100 * both >= percent * (n[:, None] + m[None, :] - both)) & (both > 0) & (c_a[:, None] != c_b[None, :])
                chosen = np.array(spanning(linked, c_a, c_b), np.int64).reshape(-1, 2)
                x, y = ids_a[chosen[:, 0]], ids_b[chosen[:, 1]]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def residual_links(scratch: Scratch, postings: DataFrame, sets: DataFrame, label: DataFrame, items: Callable[[DataFrame], DataFrame], shingles: Callable[[str], np.ndarray], percent: int, least: int) -> DataFrame:
    """Links (a, b) between different components of a posting that connect them as all links would.

    Large components get chunks of their own, so pairs of chunks of one component are skipped unseen. A pair is looked at
    in the posting of its least common key only, and not again if it has the posting's pivot. Chunks are bounded in members and in shingles.
    """
    known = postings.join(sets.select("id", "n"), "id").join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    known = scratch.write(known, "known")
    shares = known.groupBy("key", "c").agg(F.greatest(F.count("*") / CHUNK, F.sum("n") / MASS).alias("size"), F.count("*").alias("ids"), F.min("id").alias("least"))
    large = F.col("size") >= 0.25
    mixed = shares.groupBy("key").agg(F.count("*").alias("components"), F.sum(F.when(~large, F.col("size")).otherwise(0)).alias("small"), F.min("least").alias("pivot"), F.sum("ids").alias("ids")).where("components > 1 and ids > 2")
    shares = scratch.write(shares.drop("ids").join(mixed, "key").select("key", "c", "size", "small", "pivot"), "shares")
    own = F.xxhash64("c", F.pmod(F.xxhash64("id"), F.ceil("size")))
    common = F.pmod(F.xxhash64("c"), F.ceil("small"))
    chunked = scratch.write(known.join(shares, ["key", "c"]).withColumn("chunk", F.when(large, own).otherwise(common)).drop("size", "small", "n"), "chunked")
    met_ids = scratch.write(chunked.select("id").distinct(), "met-ids")
    keys = scratch.write(postings.join(met_ids, "id").groupBy("id").agg(F.collect_list("key").alias("keys")), "keys")
    signed = scratch.write(sets.join(keys, "id"), "met-sets")
    member = F.struct("id", "c", "n", "sig", "keys")
    chunks = scratch.write(chunked.join(signed, "id").groupBy("key", "chunk").agg(F.collect_list(member).alias("members"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("pivot").alias("pivot")), "chunks")
    x = chunks.select("key", F.col("chunk").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), "pivot", F.col("members").alias("left"))
    y = chunks.select("key", F.col("chunk").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), F.col("members").alias("right"))
    alike = (F.col("lo_i") == F.col("hi_i")) & (F.col("lo_j") == F.col("hi_j")) & (F.col("lo_i") == F.col("lo_j"))
    met = x.join(y, "key").where((F.col("i") <= F.col("j")) & ~alike).select("key", "i", "j", "pivot", "left", "right")
    blocks = scratch.write(met.mapInArrow(_candidates(percent, least), "key long, i long, j long, ids_a array<long>, c_a array<long>, ids_b array<long>, c_b array<long>"), "blocks")
    side = lambda k, ids, c: F.transform(F.arrays_zip(F.col(ids).alias("id"), F.col(c).alias("c")), lambda m: F.struct(F.lit(k).alias("side"), m["id"].alias("id"), m["c"].alias("c")))
    members = scratch.write(blocks.select("key", "i", "j", F.explode(F.concat(side(0, "ids_a", "c_a"), side(1, "ids_b", "c_b"))).alias("m")).select("key", "i", "j", "m.*"), "block-members")
    texts = scratch.write(items(members.select("id").distinct()), "residual-texts")
    whole = members.join(texts, "id").groupBy("key", "i", "j").agg(F.collect_list(F.struct("side", "id", "c", "text")).alias("members"))
    links = scratch.write(whole.select("members").mapInArrow(_block_verifier(shingles, percent), "a long, b long").distinct(), "residual-verified")
    scratch.drop("keys", "met-ids", "met-sets", "known", "shares", "chunked", "chunks", "blocks", "block-members", "residual-texts")
    scratch.release()
    return links


def link(scratch: Scratch, postings: DataFrame, members: DataFrame, items: Callable[[DataFrame], DataFrame], shingles: Callable[[str], np.ndarray], percent: int) -> DataFrame:
    """(id, component) of all ids with a link. members is a written table; items: ids -> their (id, text)."""
    least = bound(percent / 100)
    postings = scratch.write(postings, "postings")
    pairs = scratch.write(pivot_pairs(scratch, postings, members, percent, least), "pivot-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = scratch.write(items(ids), "pivot-texts")
    first = scratch.write(verified(pairs, texts, shingles, percent), "pivot-verified")
    scratch.drop("pivot-texts", "pivot-pairs", "pivots", "stars")
    scratch.release()
    label = components(scratch, first, "first")
    second = residual_links(scratch, postings, members, label, items, shingles, percent, least)
    label = components(scratch, first.union(second), "all")
    scratch.drop("postings")
    return label
