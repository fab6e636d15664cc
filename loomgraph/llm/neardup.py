"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets form one class. A class has 64 MinHash coordinates, of which 32 are posted. Each posted
(coordinate, value) that several classes share is a posting. Linked classes agree in at least
MATCHES of the 32 coordinates (but for a chance below 1e-6), so a class with fewer shared coordinates is done; of the
others only a prefix is posted: with m shared coordinates, the m - MATCHES + 1 rarest. Two classes with MATCHES common
coordinates have one in both prefixes, whatever hot values they also share. Pairs that meet in a prefix count their
collisions over all 64 coordinates without visiting the postings beyond it, pairs above the match threshold are kept,
and links are confirmed on the full sets (see linking).

Defined results: a null or blank text has an empty set, is linked with nothing and stays; fewer than k words are one
shingle; equal texts share a component; every row of a repeated doc_id has its own text's component; a null doc_id is
no component's smallest: its row goes if its component has a numbered document, and a component of null doc_ids only is
null and stays. Extra columns, whatever their names, are ignored (near_duplicates) or kept (drop_near_duplicates).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import linking
from loomgraph.llm.common import BATCH, few, lean, shingle_hashes, texts, unused, word_hashes, words_of
from loomgraph.session import Scratch

K, PERCENT, COORDINATES, MATCHES = 3, 85, 32, 16
_RANDOM = np.random.default_rng(20240601).integers(1, 2**63, linking.SIG // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """SIG uint32 minima: two 32-bit halves of each multiplied hash."""
    low = np.full(linking.SIG, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):
        product = shingles[at : at + 1024, None] * _RANDOM[None, :]
        np.minimum(low, product.view(np.uint32).min(0), out=low)
    return low


def signature(minima: np.ndarray) -> bytes:
    """All coordinates, as linking compares them."""
    return minima.astype("<u4").tobytes()


def shingles_of(text: str, k: int = K) -> np.ndarray:
    return shingle_hashes(words_of(text), k, word_hashes())


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(word_hashes)
        for batch in batches:
            sizes, ids, values, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingles_of(text.as_py(), k)
                low = min_hashes(s)
                sizes.append(len(s))
                ids.append(int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) if len(s) else None)
                values.append(low[:COORDINATES].view(np.int32) if len(s) else None)
                sigs.append(signature(low) if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int32())), pa.array(sigs, pa.binary())], names=["doc_id", "t", "n", "id", "minima", "sig"])

    return run


def prefix_postings(scratch: Scratch, classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(key, id) of the rare prefixes; classes: (id, minima)."""
    coordinates = classes.select("id", F.posexplode("minima").alias("k", "value")).select("id", (F.col("value").cast("long") * 64 + F.col("k")).alias("key"))
    shared = scratch.write(coordinates.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "coordinates")
    by_rarity = coordinates.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("entries")).where(F.size("entries") >= matches)
    prefix = by_rarity.select("id", F.explode(F.expr(f"slice(entries, 1, size(entries) - {matches} + 1)")).alias("e"))
    return prefix.select(F.col("e.key").alias("key"), "id")


def _decided(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and t, a hash of the text."""
    scratch = Scratch(spark, "neardup", BATCH)
    docs = texts(docs).withColumn("t", F.xxhash64("text"))
    signed = scratch.write(docs.select("doc_id", "text", "t").mapInArrow(_signer(k), "doc_id long, t long, n long, id long, minima array<int>, sig binary"), "signed")
    # one row stands for all rows of a class
    classes = scratch.write(signed.where("id is not null").groupBy("id", "n", "minima", "sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("r")).select("id", "n", "minima", "sig", "r.doc_id", "r.t"), "classes")
    postings = scratch.write(prefix_postings(scratch, classes), "prefixes")
    scratch.drop("coordinates")
    posted = classes.join(postings.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("d"), F.col("t").alias("own"))
    posted = few(scratch.write(posted, "posted"))
    same = docs["doc_id"].eqNullSafe(posted["d"]) & (docs["t"] == posted["own"])
    full = scratch.write(docs.join(posted, same).select("id", "text").dropDuplicates(["id"]), "texts")
    scratch.release()

    def items(wanted: DataFrame) -> DataFrame:
        return full.join(wanted, "id", "left_semi")

    label = linking.link(scratch, postings, classes.select("id", "n", "sig"), items, functools.partial(shingles_of, k=k), percent)
    labelled = classes.select("id", "doc_id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.write(labelled.join(least, "component").select("id", "component_id"), "of-class")
    members = signed.select("doc_id", "t", F.col("n").alias("n_shingles"), "id").join(of_class, "id", "left")
    component = F.coalesce("component_id", "doc_id")
    scratch.drop("classes", "prefixes", "posted", "texts")
    return members.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "t")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return _decided(spark, docs, k, percent).drop("t")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, with all their columns: the least doc_id of each component."""
    doc, t = unused(docs.columns, "gone_doc"), unused(docs.columns, "gone_t")
    gone = _decided(spark, docs, k, percent).where("not kept").select(F.col("doc_id").alias(doc), F.col("t").alias(t)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[t])
    return docs.join(gone, same, "left_anti")
