"""Word-level encoding with the tokenizers library, cached by white-space chunk."""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

from loomgraph.llm.common import worker_cache


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(chunk: bytes) -> bool:
    """Whether a chunk is one run of letters after normalisation too (a capital dotted I is not)."""
    if chunk.isascii():
        return chunk.isalpha()
    return unicodedata.normalize("NFC", chunk.decode("utf-8", "surrogatepass")).lower().isalpha()


class ChunkEncoder:
    """Ids of whole texts as little-endian uint32 bytes, equal to the library's.

    The tokenizer lower-cases, drops white space before merging, and merges runs of letters and runs of other signs apart.
    So no token, normalisation or special token crosses a blank, tab or line feed, and a run of letters has the same ids
    with or without marks behind it: the ids of a text are those of its chunks in order. New chunks are encoded by
    the library, many letter runs in one call, whose ids are told apart by the word-end mark. Texts that may hold a
    special token go to the library as they are. The cache has two generations of bounded size, about 600,000 chunks each.
    """

    GENERATION, JOINED, MARKS = 96 << 20, 256, b".,!?;:*&%$#|-)"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith("</w>")
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        self.new[chunk] = ids
        self.held += len(chunk) + len(ids) + 150

    def _fill(self, chunks: set[bytes]) -> None:
        letters: set[bytes] = set()
        stopped: list[bytes] = []
        for chunk in chunks:
            if chunk in self.old:
                self._keep(chunk, self.old[chunk])
                continue
            core = chunk.rstrip(self.MARKS)
            if _letters(core):
                if core not in self.new:
                    letters.add(core)
                if len(core) < len(chunk):
                    stopped.append(chunk)
            else:
                self._keep(chunk, self.library(chunk.decode("utf-8", "surrogatepass")))
        known = [w for w in letters if w in self.old]
        for w in known:
            self._keep(w, self.old[w])
        words = list(letters.difference(known))
        for at in range(0, len(words), self.JOINED):
            part = words[at : at + self.JOINED]
            raw = self.library(" ".join(w.decode() for w in part))
            ends = np.nonzero(self.ends[np.frombuffer(raw, "<u4")])[0] + 1
            if len(ends) == len(part):
                start = 0
                for w, end in zip(part, ends.tolist()):
                    self._keep(w, raw[4 * start : 4 * end])
                    start = end
            else:  # a letter whose lower case is none
                for w in part:
                    self._keep(w, self.library(w.decode()))
        for chunk in stopped:
            core = chunk.rstrip(self.MARKS)
            mark = chunk[len(core) :]
            if mark not in self.new:
                self._keep(mark, self.library(mark.decode()))
            self._keep(chunk, self.new[core] + self.new[mark])

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if b"<|" in raw:
            return self.library(text)
        chunks = raw.lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ")
        ids = list(map(self.new.get, chunks))
        if None in ids:
            if self.held > self.GENERATION:
                self.old, self.new, self.held = self.new, {b"": b""}, 0
            self._fill({c for c in chunks if c not in self.new})
            ids = map(self.new.__getitem__, chunks)
        return b"".join(ids)


@worker_cache
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker."""
    return ChunkEncoder(path)
