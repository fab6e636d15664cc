"""Repeated passages: paragraph MinHash banding for edited ones, confirmed matches to their true edges for verbatim ones.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; line breaks and punctuation marks play no part. One pass over the texts
writes, for every text of RUN words or more, its paragraphs and its anchors.

Near: paragraphs are cut by content, where the hash of two neighbouring words is the least of GAP words on either side,
so that a passage has the same paragraphs wherever it stands (25 words at least inside a text, 49 on average); lines of
at least NEAR words are paragraphs too, as edits never move their borders (lines meet lines only, or each would meet the
paragraphs inside it). All are banded: 12 bands of 3 coordinates over five-word shingles (a pair at the
similarity 0.8 shares a band but for a chance of 2e-4; fewer, wider bands bring more false pairs than they save). Colliding paragraphs are joined and verified on their
exact Jaccard similarity, and components cluster them (see linking). In each cluster the first place, by (doc_id, start), is kept. Near paragraphs that touch, in the text
and in one and the same source, form pieces; pieces of at least RUN words are removed.

Exact: a passage of RUN words or more that occurs at an earlier place, by (doc_id, word), is repeated, to its very first and
last word. Texts meet on anchors, the least hashes of ANCHOR_WORDS words among ANCHOR neighbours (winnowing: any RUN words
in common have an anchor in common). Neighbouring anchors overlap, so a chain of them with one source at one distance is
a repetition as it stands; the windows of RUN words at the chains' edges and wherever else anchors repeat are looked up. A
repetition that overlaps its own source does not count.

Nothing between passages is removed: shorter repetitions (headings, stock phrases) and unrepeated words stay.

Defined results: null texts are empty and have no passages; rows that repeat a doc_id and text are the same place, so
none of them is a repetition of another; null doc_ids sort first; of equal places the least (doc_id, hash of the text, word)
is the first; offsets are code points, end exclusive; extra columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import linking
from loomgraph.llm.common import BATCH, consecutive_hashes, few, lean, mix64, shingle_hashes, texts, unused, word_hashes, words_of
from loomgraph.llm.neardup import _RANDOM, min_hashes, signature
from loomgraph.session import Scratch

K, PERCENT, GAP, NEAR, RUN = 5, 80, 24, 30, 32
ANCHOR, ANCHOR_WORDS = 16, 17  # ANCHOR + ANCHOR_WORDS - 1 = RUN: no common run of RUN words is without a common anchor
BANDS, ROWS = 12, 3
PASSES = 4  # band keys and windows are shuffled in so many portions, one after the other, or their files were the most of the disk


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = least(x[:-step], x[step:])
        done += step
    return x


class Words:
    """The words of a batch of texts: hashes, offsets in code points, the line each is in, and the bounds of the texts in words.
    All arrays run over the whole batch."""

    def __init__(self, column: pa.StringArray):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = _INSIDE[data]
        begins = offsets[:-1][offsets[:-1] < len(data)]  # no word crosses from one text into the next
        before, after = np.append(False, inside[:-1])[: len(data)], np.append(inside[1:], False)[: len(data)]
        before[begins] = False
        after[begins[begins > 0] - 1] = False
        start, end = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
        self.bounds = np.searchsorted(start, offsets)
        points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
        base = np.append(0, points)[np.minimum(offsets[:-1], len(data))]
        base = np.repeat(base, np.diff(self.bounds))
        self.start, self.end = (points[start] - 1 - base).astype(np.int32), (points[end - 1] - base).astype(np.int32)
        self.line = np.cumsum(data == 10, dtype=np.int32)[start]
        self.h = self._hashes(data, start, end - start)

    @staticmethod
    def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """FNV-1a of each word in lower case, a byte of all words at a time; very long words by another hash."""
        order = np.argsort(np.minimum(size, _LONG + 1).astype(np.uint16), kind="stable")[::-1]
        at, sizes = start[order], size[order]
        h = np.full(len(at), 0xCBF29CE484222325, np.uint64)
        many = np.searchsorted(-sizes, -_LONG, "left")  # words longer than _LONG come first
        for k in range(many):
            h[k] = xxhash.xxh64_intdigest(_LOWER[data[at[k] : at[k] + sizes[k]]].tobytes())
        rest, at, sizes = h[many:], at[many:], sizes[many:]
        for j in range(int(sizes[0]) if len(sizes) else 0):
            n = np.searchsorted(-sizes, -j, "left")
            rest[:n] ^= _LOWER[data[at[:n] + j]]
            rest[:n] *= np.uint64(0x100000001B3)
        out = np.empty(len(order), np.uint64)
        out[order] = mix64(h)
        return out


_INSIDE = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LONG, _BYTES = 200, 1 << 20


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about _BYTES of text at most, a text at least."""
    for batch in batches:
        text = batch.column("text")
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + _BYTES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def borders(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first words of the paragraphs of texts with the bounds [a, b] in words, first words of texts that have any among them."""
    sizes = np.diff(bounds)
    fresh = np.zeros(len(h), bool)
    fresh[bounds[:-1][sizes > 0]] = True
    if len(h) < 2 * GAP + 2:
        return np.nonzero(fresh)[0]
    x = consecutive_hashes(h, 2)
    low = _sliding(x, GAP, np.minimum)
    inner = x[GAP:-GAP]
    least = (inner < low[: len(inner)]) & (inner <= low[GAP + 1 : GAP + 1 + len(inner)])
    at = np.nonzero(least)[0] + GAP
    text = np.searchsorted(bounds, at, "right") - 1
    whole = (at - bounds[text] >= GAP) & (bounds[text + 1] - at >= GAP + 2)  # GAP pairs of the text on either side
    fresh[at[whole]] = True
    return np.nonzero(fresh)[0]


def anchors(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the windows of ANCHOR_WORDS words whose hash is the least among some ANCHOR neighbours of their text."""
    if len(h) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = consecutive_hashes(h, ANCHOR_WORDS)
    low = _sliding(x, ANCHOR, np.minimum)
    left = np.repeat(bounds[1:], np.diff(bounds))[: len(low)] - np.arange(len(low))
    low[left < RUN] = 0  # these cross into the next text
    edge = np.zeros(ANCHOR - 1, np.uint64)
    at = np.nonzero(x == _sliding(np.concatenate([edge, low, edge]), ANCHOR, np.maximum))[0]
    return at, x[at].view(np.int64)


def _ends(first: np.ndarray) -> np.ndarray:
    """Where the runs that begin at the true values of `first` end."""
    return np.append(np.nonzero(first)[0][1:], len(first))


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, whether it is a line) of the paragraphs of texts of RUN words or more, by first word."""
    bounds = words.bounds
    begin = borders(words.h, bounds)
    end = np.append(begin[1:], len(words.h))
    fresh = np.ones(len(words.h), bool)
    fresh[1:] = words.line[1:] != words.line[:-1]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.nonzero(fresh)[0]
    last = _ends(fresh) if len(first) else first
    cut = np.zeros(len(words.h) + 1, np.int64)
    cut[begin] = end
    long = (last - first >= NEAR) & (cut[first] != last)
    a, b = np.append(begin, first[long]), np.append(end, last[long])
    line = np.append(np.zeros(len(begin), bool), np.ones(int(long.sum()), bool))
    size = np.diff(bounds)[np.searchsorted(bounds, a, "right") - 1]
    order = np.argsort(a, kind="stable")
    order = order[size[order] >= RUN]
    return a[order], b[order], line[order]


def paragraph_ids(h: np.ndarray, first: np.ndarray, last: np.ndarray, line: np.ndarray) -> np.ndarray:
    """64-bit hashes of the paragraphs' words."""
    sizes = last - first
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    words = h[np.repeat(first, sizes) + place]
    weight = mix64((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.add.reduceat(words * weight, at) if len(at) else np.empty(0, np.uint64)
    return mix64(total * np.uint64(2) + line.astype(np.uint64)).view(np.int64)


def band_keys(paragraphs: list[np.ndarray]) -> np.ndarray:
    """[paragraphs, BANDS] 64-bit keys, all even: MinHash over the K-word shingles of each paragraph (K word hashes or more), all at once."""
    sizes = np.array([len(p) for p in paragraphs])
    h = np.concatenate(paragraphs)
    ends = np.cumsum(sizes)
    inside = np.ones(len(h) - K + 1, bool)  # shingles that cross no border
    for j in range(1, K):
        inside[ends[:-1] - j] = False
    shingles = consecutive_hashes(h, K)[inside]
    starts = np.concatenate([[0], np.cumsum(sizes - K + 1)[:-1]])
    low = np.empty((len(paragraphs), BANDS * ROWS), np.uint32)
    for a in range(0, len(paragraphs), 256):
        b = min(len(paragraphs), a + 256)
        part = shingles[starts[a] : starts[b] if b < len(paragraphs) else None]
        product = (part[:, None] * _RANDOM[None, : BANDS * ROWS // 2]).view(np.uint32)
        low[a:b] = np.minimum.reduceat(product, starts[a:b] - starts[a], axis=0)
    keys = np.zeros((len(paragraphs), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ low.reshape(len(paragraphs), BANDS, ROWS)[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(32) + 2 * np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_UNITS = "doc_id long, t long, h array<long>, word array<int>, id array<long>, first array<int>, last array<int>, start array<int>, end array<int>, line array<int>, "
_UNITS += "".join(f"bands{k} array<array<long>>, " for k in range(PASSES)) + "part int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors and paragraphs of the texts of RUN words or more (part 0) and, apart from them, the ids and bands of the paragraphs,
    equal ones once a batch (part 1)."""
    lean(word_hashes)
    names, kinds = [c.split()[0] for c in _UNITS.split(", ")], [pa.int64(), pa.int64(), *map(pa.list_, [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 5]), *[pa.list_(pa.list_(pa.int64()))] * PASSES, pa.int32()]
    for batch in _portions(batches):
        words = Words(batch.column("text"))
        kept = np.nonzero(np.diff(words.bounds) >= RUN)[0]
        word, keys = anchors(words.h, words.bounds)
        first, last, line = paragraphs(words)
        ids = paragraph_ids(words.h, first, last, line)
        unique = np.sort(np.unique(ids, return_index=True)[1])
        bands = band_keys([words.h[a:b] for a, b in zip(first[unique].tolist(), last[unique].tolist())]) ^ line[unique, None] if len(unique) else np.empty((0, BANDS), np.int64)

        def lists(at: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
            """Values in order of their words -> a list for each kept text."""
            ends = np.append(np.searchsorted(at, words.bounds[kept]), len(at)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))

        base = lambda at: words.bounds[np.searchsorted(words.bounds, at, "right") - 1]
        own = base(first)
        int32 = lambda x: x.astype(np.int32)
        columns = [lists(word, keys), lists(word, int32(word - base(word))), lists(first, ids), lists(first, int32(first - own)), lists(first, int32(last - own))]
        columns += [lists(first, words.start[first]), lists(first, words.end[last - 1]), lists(first, int32(line))]
        rows = pa.array(kept, pa.int32())
        wide = BANDS // PASSES
        inner = [pa.ListArray.from_arrays(pa.array(np.arange(len(unique) + 1, dtype=np.int32) * wide), pa.array(bands[:, k : k + wide].reshape(-1), pa.int64())) for k in range(0, BANDS, wide)]
        banded = {"id": lists(first[unique], ids[unique]), **{f"bands{k}": lists(first[unique], x) for k, x in enumerate(inner)}}
        own = dict(zip(names, [batch.column("doc_id").take(rows), batch.column("t").take(rows), *columns]))
        for part, filled in enumerate((own, banded)):
            filled["part"] = pa.array(np.full(len(kept), part, np.int32))
            yield pa.record_batch([filled.get(c, pa.nulls(len(kept), kind)) for c, kind in zip(names, kinds)], names=names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with wanted spots -> (id, text) of these."""
    for batch in batches:
        ids, parts = [], []
        for text, spots in zip(batch.column("text"), batch.column("spots").to_pylist()):
            text = text.as_py()
            ids += [s["id"] for s in spots]
            parts += [text[s["start"] : s["end"]] for s in spots]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], names=["id", "text"])


def _shingles(text: str) -> np.ndarray:
    return shingle_hashes(words_of(text), K, word_hashes())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [_shingles(t.as_py()) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(min_hashes(s)) for s in sets], pa.binary())], names=["id", "n", "sig"])


def _at(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(found["at_doc"]) & (docs["t"] == found["at_t"])


def near_paragraphs(scratch: Scratch, docs: DataFrame, bands: DataFrame, places: DataFrame) -> DataFrame:
    """(id, component) of the paragraphs that have near copies. The bands are dropped as soon as they are counted."""
    tables = []
    for k in range(PASSES):
        keys = bands.select(F.explode(F.arrays_zip("id", f"bands{k}")).alias("p")).select(F.col("p.id").alias("id"), F.explode(f"p.bands{k}").alias("key"))
        ids = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        shared = scratch.write(ids, "shared")
        scratch.release()
        two = shared.where("n = 2").select("key", F.explode(F.array("lo", "hi")).alias("id"))  # met already
        more = keys.join(few(shared.where("n > 2").select("key")), "key").select("key", "id").distinct()
        tables.append(scratch.write(two.unionByName(more), f"collided-{k}"))
        scratch.drop("shared")
        scratch.release()
    scratch.drop("units/part=1")
    collided = functools.reduce(DataFrame.unionByName, tables)
    wanted = scratch.write(collided.select("id").distinct(), "wanted")
    scratch.release()
    one = places.join(few(wanted), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "t", "start", "end")).alias("p"))
    spots = one.groupBy(F.col("p.doc_id").alias("at_doc"), F.col("p.t").alias("at_t")).agg(F.collect_list(F.struct("id", "p.start", "p.end")).alias("spots"))
    spots = scratch.write(spots, "spots")
    lines = docs.join(spots, _at(docs, spots)).select("text", "spots").mapInArrow(_slices, "id long, text string")
    lines = scratch.write(lines.groupBy("id").agg(F.min("text").alias("text")), "lines")
    scratch.release()
    signatures = scratch.write(lines.mapInArrow(_signatures, "id long, n long, sig binary"), "signatures")
    scratch.drop("wanted", "spots")
    scratch.release()
    return linking.link(scratch, collided.select("key", "id"), signatures, lambda ids: lines.join(ids, "id", "left_semi"), _shingles, PERCENT)


def near_places(scratch: Scratch, docs: DataFrame, units: DataFrame, bands: DataFrame) -> DataFrame:
    """Every later place of a near paragraph: doc_id, t, start, end, first_word, last_word, component, first."""
    p = F.explode(F.arrays_zip("id", "first", "last", "start", "end", "line")).alias("p")
    places = units.select("doc_id", "t", p).select("doc_id", "t", "p.id", "p.start", "p.end", "p.line", F.col("p.first").alias("first_word"), F.col("p.last").alias("last_word"))
    near = scratch.write(near_paragraphs(scratch, docs, bands, places), "clusters")
    scratch.drop(*[f"collided-{k}" for k in range(PASSES)], "lines", "signatures")
    found = scratch.write(places.join(near, "id").drop("id"), "places")
    scratch.release()
    place = F.struct("doc_id", "t", "start", "first_word", "last_word")
    first = scratch.write(found.groupBy("component").agg(F.min(place).alias("first")), "first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    later = found.join(first, "component").where(~same | (F.col("first_word") >= F.col("first.last_word"))).dropDuplicates(["doc_id", "t", "line", "start"])
    order = Window.partitionBy("doc_id", "t", "line").orderBy("start")
    source = F.lag("first").over(order)
    touch = (F.lag("last_word").over(order) == F.col("first_word")) & source["doc_id"].eqNullSafe(F.col("first.doc_id")) & (source["t"] == F.col("first.t")) & (source["last_word"] == F.col("first.first_word"))
    pieces = later.withColumn("fresh", F.when(touch, 0).otherwise(1)).withColumn("piece", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.sum(F.col("last_word") - F.col("first_word")).over(Window.partitionBy("doc_id", "t", "line", "piece"))
    kept = pieces.withColumn("words", words).where(F.col("words") >= RUN)
    return kept.select("doc_id", "t", "start", "end", "first_word", "last_word", "component", F.struct("first.doc_id", "first.t", F.col("first.first_word").alias("word")).alias("first"))


def repetitions(h: np.ndarray, bounds: np.ndarray, text: np.ndarray, n: np.ndarray, word: np.ndarray, source: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the repeated anchors of texts say, in order of (text, n), n being the anchor's number in its text: the words where
    windows are to be looked up, and the chains (first word, end, anchor) that are repetitions as they stand. source is -1 where an
    anchor has none but itself. A window that is repeated has its least hash in common with its copy, so only windows whose
    own anchor is repeated are looked up."""
    none = np.empty(0, np.int64)
    if len(h) < RUN or not len(word):
        return none, none, none, none
    fresh = np.append(True, (text[1:] != text[:-1]) | (n[1:] != n[:-1] + 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]))
    begin, end = np.nonzero(fresh)[0], _ends(fresh)
    lo, hi = word[begin], word[end - 1] + ANCHOR_WORDS
    whole = (source[begin] >= 0) & (hi - lo >= RUN)
    lo, hi, begin = lo[whole], hi[whole], begin[whole]
    x = consecutive_hashes(h, ANCHOR_WORDS) | np.uint64(1)
    x[word] ^= np.uint64(1)  # even: repeated
    low = _sliding(x, ANCHOR, np.minimum)
    left = np.repeat(bounds[1:], np.diff(bounds))[: len(low)] - np.arange(len(low))
    known = np.zeros(len(low) + 1, np.int32)
    np.add.at(known, lo, 1)
    np.add.at(known, hi - RUN + 1, -1)
    look = (low & np.uint64(1) == 0) & (left >= RUN) & (np.cumsum(known)[:-1] == 0)
    return np.nonzero(look)[0], lo, hi, begin


_FOUND = "h long, doc_id long, t long, word int, last int, start int, end int, first_doc long, first_t long, first_word int"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated anchors -> chains (h is null, with their sources) and windows of RUN words to look up."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    lean()
    for batch in _portions(batches):
        lists = batch.column("found")
        ends, values = lists.offsets.to_numpy(), lists.values
        n, word, w = (values.field(c).to_numpy() for c in ("n", "word", "w"))
        source = np.where(values.field("own").to_numpy(zero_copy_only=False), np.where(word - w >= RUN, 0, -1), values.field("s").to_numpy())
        words = Words(batch.column("text"))
        text = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        order = np.lexsort((n[ends[0] : ends[-1]], text))
        text, order = text[order], order + ends[0]
        once = np.append(True, (text[1:] != text[:-1]) | (n[order[1:]] != n[order[:-1]]))[: len(order)]
        text, order = text[once], order[once]
        at, lo, hi, anchor = repetitions(words.h, words.bounds, text, n[order], word[order] + words.bounds[text], source[order], (word - w)[order])
        anchor = order[anchor]
        for first, last in ((at, at + RUN), (lo, hi)):
            if len(first):
                text = np.searchsorted(words.bounds, first, "right") - 1
                own = pa.array(text)
                place = [pa.array(x.astype(np.int32)) for x in (first - words.bounds[text], last - words.bounds[text], words.start[first], words.end[last - 1])]
                if first is lo:
                    of = pa.array(anchor)
                    source_of = [values.field("s_doc").take(of), values.field("s_t").take(of), pa.array((first - words.bounds[text] - (word - w)[anchor]).astype(np.int32))]
                    h = pa.nulls(len(first), pa.int64())
                else:
                    source_of = [pa.nulls(len(first), kind) for kind in (pa.int64(), pa.int64(), pa.int32())]
                    h = pa.array(consecutive_hashes(words.h, RUN)[first].view(np.int64))
                yield pa.record_batch([h, batch.column("doc_id").take(own), batch.column("t").take(own), *place, *source_of], names=names)


def exact_places(scratch: Scratch, docs: DataFrame, units: DataFrame) -> DataFrame:
    """Every verbatim repetition of RUN words or more: the columns of near_places. Joins on hashes start from written tables, so
    that Spark can split their hot keys; counts and firsts are aggregated together, and before the shuffle."""
    place = F.struct("doc_id", "t", "word")
    again = [F.min(place).alias("f"), F.count("*").alias("n")]
    own = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t") == F.col("f.t"))
    placed = units.select("doc_id", "t", F.posexplode(F.arrays_zip("h", "word")).alias("n", "a")).select("doc_id", "t", "n", "a.h", "a.word")
    first = scratch.write(placed.groupBy("h").agg(*again).where("n > 1").select("h", "f"), "first-anchors")
    scratch.release()
    common = scratch.write(placed.join(first, "h").drop("h"), "common")
    scratch.drop("units", "first-anchors")  # units are by far the largest table, read for the last time
    scratch.release()
    entry = F.struct("n", "word", own.alias("own"), F.shiftrightunsigned(F.xxhash64("f.doc_id", "f.t"), 1).alias("s"), F.col("f.word").alias("w"), F.col("f.doc_id").alias("s_doc"), F.col("f.t").alias("s_t"))
    anchored = common.groupBy(F.col("doc_id").alias("at_doc"), F.col("t").alias("at_t")).agg(F.collect_list(entry).alias("found"))
    anchored = scratch.write(anchored, "anchored")
    scratch.drop("common")
    scratch.release()
    found = scratch.write(docs.join(anchored, _at(docs, anchored)).select("doc_id", "t", "text", "found").mapInArrow(_found, _FOUND), "found")
    scratch.drop("anchored")
    scratch.release()
    columns = ["doc_id", "t", "start", "end", F.col("word").alias("first_word"), F.col("last").alias("last_word")]
    source = F.struct(F.col("first_doc").alias("doc_id"), F.col("first_t").alias("t"), F.col("first_word").alias("word"))
    tables = [scratch.write(found.where("h is null").select(*columns, F.xxhash64("first_doc", "first_t", found["first_word"]).alias("component"), source.alias("first")), "chains")]
    for k in range(PASSES):
        windows = found.where(F.pmod("h", F.lit(PASSES)) == k).select("h", "doc_id", "t", "word", "last", "start", "end")
        # most windows occur once, so their places are joined with the firsts of repeated ones only
        firsts = scratch.write(windows.groupBy("h").agg(*again).where("n > 1").select("h", "f"), "first-windows")
        scratch.release()
        later = windows.join(firsts, "h").where(~own | (F.col("word") - F.col("f.word") >= RUN))
        tables.append(scratch.write(later.select(*columns, F.xxhash64("h").alias("component"), F.col("f").alias("first")), f"windows-{k}"))
        scratch.drop("first-windows")
        scratch.release()
    scratch.drop("found")
    return functools.reduce(DataFrame.unionByName, tables)


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per passage to remove: doc_id, start, end, n_words, component, first_doc_id, first_word (of the kept place, in
    words), and t (a hash of the document's text)."""
    scratch = Scratch(spark, "substring", BATCH)
    docs = texts(docs).withColumn("t", F.xxhash64("text"))
    units = scratch.write(docs.select("doc_id", "t", "text").mapInArrow(_units, _UNITS), "units", parts="part")
    bands, units = (units.where(F.col("part") == k).drop("part") for k in (1, 0))
    near = near_places(scratch, docs, units, bands)
    again = near.unionByName(exact_places(scratch, docs, units))
    order = Window.partitionBy("doc_id", "t").orderBy("start", F.desc("end"))
    reach = F.coalesce(F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = again.withColumn("fresh", (F.col("first_word") > reach).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.struct("start", "end")
    words = F.max("last_word") - F.min("first_word")
    passages = runs.groupBy("doc_id", "t", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), words.alias("n_words"), F.min_by("component", head).alias("component"), F.min_by("first", head).alias("first")).where(F.col("n_words") >= RUN)
    result = scratch.write(passages.select("doc_id", "start", "end", "n_words", "component", F.col("first.doc_id").alias("first_doc_id"), F.col("first.word").alias("first_word"), "t"), "passages")
    scratch.drop("places", "clusters", "first", "chains", *[f"windows-{k}" for k in range(PASSES)])
    return result


def _cutter(text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, keep = [], []
            for cell, spans in zip(batch.column(text_at), batch.column(batch.num_columns - 1).to_pylist()):
                text = cell.as_py()
                if spans:
                    at, parts = 0, []
                    for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
                        parts.append(text[at : span["start"]])
                        at = max(at, span["end"])
                        if text[at : at + 1] == "\n" and (not parts[-1] or parts[-1].endswith("\n")):
                            at += 1
                    text = "".join(parts) + text[at:]
                new.append(text)
                keep.append(not spans or bool(text.strip()))
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(new, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in new], columns[chars_at].type)
            yield pa.record_batch(columns, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return run


def drop_repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with all their columns, without repeated passages; a document that was nothing else is dropped."""
    doc, t, cuts = (unused(docs.columns, c) for c in ("cut_doc", "cut_t", "cut_spans"))
    spans = repeated_passages(spark, docs).groupBy(F.col("doc_id").alias(doc), F.col("t").alias(t)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    spans = Scratch(spark, "substring-spans").write(spans, "spans")
    same = docs["doc_id"].cast("long").eqNullSafe(spans[doc]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == spans[t])
    joined = docs.join(spans, same, "left").drop(doc, t)
    names = docs.columns
    return joined.mapInArrow(_cutter(names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)
