"""Token counts under a unigram model, by dynamic programming shared along a trie.

Pre-tokens are the white-space separated chunks of a text with a leading word mark. The pieces and their order come
from a public model file; the log-probability of the piece of rank r follows Zipf's law, -ln((r + 2) * H). The best
segmentation of a pre-token has the highest sum of log-probabilities, then the fewest tokens; a character without a
piece costs one token per UTF-8 byte. The forward score of a prefix depends on the prefix alone, so distinct
pre-tokens are inserted into a trie, each node's score is computed once from its ancestors', and the end of a
pre-token stores its count. Trie and counts are per Python worker and bounded.

Defined results: null texts are empty: no pre-tokens, no tokens; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.common import texts

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def unigram(path: str) -> dict[str, float]:
    """piece -> log-probability; bytes, control and mark-only runs are left to the fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = [p for i in kept if len(p := model.id_to_piece(i)) == 1 or p.strip(MARK)]
    order = sorted(range(len(pieces)), key=lambda k: k)
    norm = math.log(sum(1 / (r + 2) for r in order))
    return {pieces[r]: -math.log(r + 2) - norm for r in order}


class Trie:
    """Prefixes of the pre-tokens met so far, with the forward score of each; ends store their counts.

    The pieces that may end at a place are found by their last three characters: a table of the lengths there are.
    """

    NODES, ENDS = 1_000_000, 600_000

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values()) - 10
        lengths: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {tail: tuple(sorted(x)) for tail, x in lengths.items()}
        self.terminal: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.best, self.tokens = array("d", [0.0]), array("i", [0])

    def count(self, chunk: str) -> int:
        """Tokens of the pre-token MARK + chunk; inserts it if it is new."""
        got = self.terminal.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is None:
                got = self._insert(MARK + chunk)
            if len(self.terminal) >= self.ENDS:
                self.older, self.terminal = self.terminal, {}
            if len(chunk) <= 64:
                self.terminal[chunk] = got
        return got

    def _insert(self, token: str) -> int:
        if len(self.best) > self.NODES:
            self.reset()
        long = len(token) > 64  # not kept: it would rarely be met again
        scores, nexts, best, tokens = self.scores, self.next, self.best, self.tokens
        node, path_score, path_tokens = 0, [0.0], [0]
        for end in range(1, len(token) + 1):
            char = token[end - 1]
            key = node * 0x110000 + ord(char)
            child = 0 if long else nexts.get(key, 0)
            if child:
                node = child
                path_score.append(best[node])
                path_tokens.append(tokens[node])
                continue
            top, used = -math.inf, 0
            one = scores.get(char)
            if one is None:
                size = len(char.encode("utf-8", "surrogatepass"))
                top, used = path_score[end - 1] + self.unknown * size, path_tokens[end - 1] + size
            else:
                top, used = path_score[end - 1] + one, path_tokens[end - 1] + 1
            if end > 1:
                two = scores.get(token[end - 2 : end])
                if two is not None:
                    score, n = path_score[end - 2] + two, path_tokens[end - 2] + 1
                    if score > top or (score == top and n < used):
                        top, used = score, n
                if end > 2:
                    for length in self.lengths.get(token[end - 3 : end], ()):
                        start = end - length
                        if start < 0:
                            break
                        value = scores.get(token[start:end])
                        if value is not None:
                            score, n = path_score[start] + value, path_tokens[start] + 1
                            if score > top or (score == top and n < used):
                                top, used = score, n
            path_score.append(top)
            path_tokens.append(used)
            if not long:
                best.append(top)
                tokens.append(used)
                nexts[key] = node = len(best) - 1
        return path_tokens[-1]


@functools.cache
def trie(path: str) -> Trie:
    return Trie(unigram(path))


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = trie(path)
        for batch in batches:
            n_tokens, n_chunks, distinct = [], [], []
            for text in batch.column(1):
                chunks = text.as_py().split()
                n_chunks.append(len(chunks))
                distinct.append(len(set(chunks)))
                counts = list(map(shared.terminal.get, chunks))
                if None in counts:
                    counts = map(shared.count, chunks)
                n_tokens.append(sum(counts))
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_tokens, n_chunks, distinct))], names=["doc_id", "n_tokens", "n_pretokens", "n_distinct_pretokens"])

    return run


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_distinct_pretokens: one pass, no shuffle."""
    return texts(docs).mapInArrow(_counter(model or default_model()), "doc_id long, n_tokens long, n_pretokens long, n_distinct_pretokens long")
