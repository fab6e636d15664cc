"""Byte-level BPE by the tiktoken library and a local rank file.

Long texts are cut before a white-space character that follows another character: no match of the pattern
holds a non-space followed by a space, and its one look-ahead only looks along a run of white space, so the
ids of the pieces in order are those of the whole text. Decoding joins the raw bytes of the ids.

Defined results: null texts are empty (0 tokens, hashes of no bytes); repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import texts

PIECE = 1 << 16  # characters after which a text is cut at the next safe boundary
_SAFE = re.compile(r"(?<=[^\s])(?=[ \n\t\r])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str) -> Iterator[list[int]]:
    enc = encoding(path)
    for piece in pieces(text):
        yield enc.encode_ordinary(piece)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            counts, id_hashes, byte_hashes = [], [], []
            for text in batch.column(1):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode(text.as_py(), path):
                    of_ids.update((" " * (n > 0 and len(ids) > 0) + " ".join(map(str, ids))).encode())
                    of_bytes.update(enc.decode_bytes(ids))
                    n += len(ids)
                counts.append(n)
                id_hashes.append(of_ids.hexdigest())
                byte_hashes.append(of_bytes.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one pass over the texts, no shuffle."""
    return texts(docs).mapInArrow(_digests(ranks or default_ranks()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[i for part in encode(t.as_py(), path) for i in part] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else enc.decode_bytes(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return run


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids."""
    return texts(docs).mapInArrow(_encoder(ranks or default_ranks()), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, bytes, of a table (doc_id, ids): raw bytes, valid UTF-8 only if the ids are those of whole texts."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(ranks or default_ranks()), "doc_id long, bytes binary")
