"""Token ids as fixed-width bit-packed blocks.

Format: a Parquet dataset with one row per block, in the order of the documents. A row holds the shard and
the block's number in it, `shard_offset` (tokens of the shard before the block), `n_tokens`, `width` (bits of
an id: the fewest that hold the vocabulary), the packed `payload` (id i occupies bits [i*width, (i+1)*width),
little-endian bit order), and for its documents `doc_ids` and `doc_lengths`. A block closes at the first end
of a document at or after BLOCK tokens, so every document lies in one block and each row can be read alone.
Blocks are found by their offsets (Parquet statistics serve as the index) and unpacked by numpy.

Defined results: null texts are empty (only the end id is stored); null doc_ids sort first; equal doc_ids
sort by text; repeated rows are stored again; an empty table gives an empty dataset; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import texts
from loomgraph.llm.tokens import default_tokenizer, encoder
from loomgraph.session import Scratch

BLOCK = 1 << 17
BLOCKS = "shard int, block int, shard_offset long, n_tokens long, width int, payload binary, doc_ids array<bigint>, doc_lengths array<bigint>"


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids to bits; whole-byte widths are plain little-endian bytes of the same layout."""
    ids = np.ascontiguousarray(ids, "<u4")
    if width % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids: parts meet at whole bytes
        bits = np.unpackbits(ids[at : at + (1 << 16)].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """Ids [start, start + count) of a payload, as uint32; reads only their bytes."""
    first, last = start * width // 8, -(-(start + count) * width // 8)
    raw = np.frombuffer(payload, np.uint8, last - first, first)
    if width % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : width // 8] = raw.reshape(count, width // 8)
        return out.view("<u4").reshape(-1)
    bits = np.unpackbits(raw, bitorder="little")[start * width - first * 8 :][: count * width].reshape(count, width)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(-1)


def _writer(path: str, end_id: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width, shard, end = width_of(enc.size), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        state = {"block": 0, "offset": 0}
        ids, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, lengths, parts, held
            payload = pack(np.frombuffer(b"".join(parts), "<u4"), width)
            row = [[shard], [state["block"]], [state["offset"]], [held], [width], [payload], [ids], [lengths]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            state["block"] += 1
            state["offset"] += held
            ids, lengths, parts, held = [], [], [], 0
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = enc.encode(text.as_py()) + end
                ids.append(doc_id)
                lengths.append(len(part) // 4)
                parts.append(part)
                held += len(part) // 4
                if held >= BLOCK:
                    yield close()
        if ids:
            yield close()

    return blocks


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Encode documents in ascending doc_id order and write them to `path` in the block format.

    One range shuffle of (doc_id, text); the hash in the range key splits a doc_id that many rows share.
    The writer's commit protocol makes lost or repeated tasks harmless.
    """
    ordered = texts(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_writer(tokenizer or default_tokenizer(), end_id), BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.cumsum(row["doc_lengths"])
            ids = unpack(row["payload"], row["width"], 0, row["n_tokens"]).astype("<u4")
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, row["doc_lengths"])]
            n = len(crcs)
            yield pa.record_batch(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["shard"], np.int32)), pa.array(row["shard_offset"] + ends - np.array(row["doc_lengths"])), pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The shard sums have one row per file."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))
    docs = blocks.mapInArrow(_reader, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, shard: int, start: int, count: int) -> np.ndarray:
    """Random access: ids [start, start + count) of a shard; only the blocks that overlap are read."""
    rows = (
        spark.read.parquet(path)
        .where((F.col("shard") == shard) & (F.col("shard_offset") < start + count) & (F.col("shard_offset") + F.col("n_tokens") > start))
        .select("shard_offset", "n_tokens", "width", "payload").orderBy("shard_offset").toLocalIterator()
    )
    parts = []
    for r in rows:
        a, b = max(start, r.shard_offset), min(start + count, r.shard_offset + r.n_tokens)
        parts.append(unpack(bytes(r.payload), r.width, a - r.shard_offset, b - a))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def token_binary(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    write_tokens(docs, f"{scratch.path}/blocks", tokenizer, end_id)
    return read_documents(spark, f"{scratch.path}/blocks")
