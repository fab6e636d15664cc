"""What the corpus operators share: text input, stable hashes, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): a null text counts as empty; other columns are dropped, whatever their names."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


BROADCAST = 1_000_000  # rows of a few numbers that are sent to all executors; more of them are joined by a shuffle


BATCH = 4 << 20  # bytes of an Arrow batch of texts, or of what else has no small rows


def few(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, from a written table, to join on: counted, and broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def unused(columns: list[str], stem: str) -> str:
    """A name that no column has, for one to be joined on."""
    taken = {c.lower() for c in columns}
    while stem in taken:
        stem += "_"
    return stem


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


_CACHES: list[Callable] = []


def worker_cache(fn: Callable) -> Callable:
    """functools.cache for what a Python worker holds on to, which `lean` lets go."""
    _CACHES.append(functools.cache(fn))
    return _CACHES[-1]


def lean(*kept: Callable) -> None:
    """Spark uses a Python worker for one operator after the other: return the memory of what others cached, and of what is free."""
    for cached in _CACHES:
        if cached not in kept:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """Word bytes -> 64-bit hash; bounded, since it is only a cache."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


@worker_cache
def word_hashes() -> WordHashes:
    """One per Python worker, for all operators."""
    return WordHashes()


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def consecutive_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k word hashes."""
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += h[j : j + n] * _MULTIPLIERS[j % 7]
    return mix64(total)


def shingle_hashes(words: list[bytes], k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words count as one shingle; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) >= k:
        return np.unique(consecutive_hashes(h, k))
    total = np.full(1, len(h), np.uint64)
    for j in range(len(h)):
        total += h[j : j + 1] * _MULTIPLIERS[j % 7]
    return np.unique(mix64(total))

