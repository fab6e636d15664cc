"""Each corpus operator against a brute-force version, with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import io
import itertools
import re
import tracemalloc
import types
import wave
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import audio, bpe, neardup, packing, pii, quality, substring, token_binary, token_counts, topk
from loomgraph.llm.tokens import ChunkEncoder, default_tokenizer

SF = "/root/testdata/sf0.001"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(100)) * (rng.random() < 0.5) for i in rng.integers(len(WORDS), size=n))


@pytest.fixture(scope="module")
def fixture_rows():
    real = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:40]
    odd = [None, "", " ", "\n\t \r\n", "a", "a b", "É é ́x ΣΑΣ. don't <|endoftext|>x", "x\u0085y \x1c z w", "word " * 30000, "a" * 5000, prose(1, 300), prose(1, 300), prose(2, 4000), "😀 " * 50]
    return [(100 - i, t) for i, t in enumerate(real + odd)]


@pytest.fixture(scope="module")
def docs(spark, fixture_rows):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in fixture_rows], "doc_id long, text string, key string, id int, t string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_pack_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 70001, dtype=np.uint64).astype(np.uint32)
    payload = token_binary.pack(ids, width)
    assert len(payload) == -(-len(ids) * width // 8)
    for a, n in ((0, len(ids)), (1, 3), (65535, 10), (70000, 1), (5, 0)):
        assert (token_binary.unpack(payload, width, a, n) == ids[a : a + n]).all()


def test_token_binary(spark, docs, fixture_rows, tmp_path):
    got = {r.doc_id: r for r in token_binary.token_binary(spark, docs).collect()}
    start, stream = 0, []
    for doc_id, text in sorted(fixture_rows):
        ids = [*library_ids(text), 1]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    path = f"file://{tmp_path}/blocks"
    token_binary.write_tokens(docs.repartition(1), path)
    shards = sorted((r.shard, r.n) for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    assert [int(x) for s, n in shards for x in token_binary.read_range(spark, path, s, 0, n)] == stream
    s, n = shards[-1]
    assert [int(x) for x in token_binary.read_range(spark, path, s, n - 7, 5)] == stream[-7:-2]
    assert token_binary.token_binary(spark, empty(spark)).count() == 0


def test_encoder_keeps_what_comes_again():
    """600,000 distinct words are encoded once, however often they come in turn."""
    enc, calls = ChunkEncoder(default_tokenizer()), []
    end = int(np.nonzero(enc.ends)[0][0])
    enc.library = lambda text: calls.append(text) or np.full(text.count(" ") + 1, end, "<u4").tobytes()
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=5), 600_000)]
    encoded = [[len(enc.encode(" ".join(words[k : k + 500]))) for k in range(0, len(words), 500)] for _ in range(2)]
    assert encoded[0] == encoded[1] and sum(text.count(" ") + 1 for text in calls) == len(words)


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(docs.withColumn("score", F.lit(1)), labels)
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.collect())
    # no label of a held-out row is used
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.quality_scores(docs, flipped), "doc_id", "predicted") == rows(got, "doc_id", "predicted")
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert rows(quality.quality_scores(odd, labels.limit(0)), "doc_id", "score", "predicted") == {(1, 0.5, 1), (2, 0.5, 1), (None, 0.5, 1)}
    assert quality.quality_scores(empty(spark), labels).count() == 0


def test_training_takes_little_of_the_driver(monkeypatch):
    """At most 3.5 times the features, which are float32 as gathered, float64 in use and half of them again for the prior."""
    rng, n = np.random.default_rng(1), 3000
    positive, x = rng.integers(0, 2, n), rng.random((n, quality.WIDTH)).astype(np.float32)
    x[positive == 1, :5] += 0.2
    table = pa.table({"positive": pa.array(positive, pa.int32()), "x": pa.array([v.tobytes() for v in x], pa.binary())})
    monkeypatch.setattr(quality, "training_rows", lambda *_: types.SimpleNamespace(toArrow=lambda: table))
    tracemalloc.start()
    try:
        weights = quality.train(None, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3.5 * x.nbytes
    scores = x @ weights[:-1]
    assert scores[positive == 1].mean() > scores[positive == 0].mean()


def test_byte_bpe(docs, fixture_rows, spark):
    import public_tokenizers

    enc = bpe.encoding(bpe.default_ranks())
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for doc_id, text in fixture_rows:
        ids = enc.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    long = (prose(5, 2000) + "   \n\n x's  ") * 20
    assert [i for part in map(enc.encode_ordinary, bpe.pieces(long, 1000)) for i in part] == enc.encode_ordinary(long)
    assert public_tokenizers.PATTERN
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()}
    assert back == {i: t or "" for i, t in fixture_rows}
    assert bpe.round_trip(empty(spark)).count() == 0


def test_packing(spark, docs, fixture_rows):
    got = packing.pack_documents(spark, docs, keep_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in fixture_rows:
        ids = [*library_ids(text), 0]
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 2048)) and [i for r in parts for i in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in parts)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.pack_documents(spark, empty(spark)).count() == 0


def test_packing_plan_is_best_fit():
    rng = np.random.default_rng(3)
    counts = collections.Counter(int(x) for x in rng.integers(1, 60, 500))
    plan = sorted(packing.plan_packing(counts, 64))
    bins = collections.defaultdict(list)
    for k, (length, rank, first, offset) in enumerate(plan):
        end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        for r in range(rank, end):
            bins[first + r - rank].append((offset, length))
    assert sum(map(len, bins.values())) == 500
    assert all(sum(n for _, n in sorted(b)[:k]) == sorted(b)[k][0] for b in bins.values() for k in range(len(b)))
    free, reference = [], 0  # plain best-fit decreasing
    for n in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in free if g >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(64 - n)
            reference += 1
    assert len(bins) <= reference + 1


def test_topk(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    data += [(i, data[50][1]) for i in range(400, 460)]  # ties
    data += [(460, None), (461, []), (462, [None] * 8), (463, [float("nan")] * 8), (464, [float("inf")] * 8), (465, [1.0] * 3), (500, [0.5] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 7, 1) for i, v in data], "vec_id long, embedding array<float>, score int, g int").repartition(5)
    got = rows(topk.top_k(spark, topk.quantised(df), F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in usable if j != q and len(b) == len(a))
            want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(scored[:5])}
    assert got == want
    assert topk.top_k(spark, topk.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_max_score_prunes_exactly():
    rng = np.random.default_rng(2)
    Q, X = np.floor(rng.normal(size=(40, 16)) * 256), np.floor(rng.normal(size=(3000, 16)) * 256)
    best = topk._Best(40, 5)
    for a in range(0, 3000, 700):
        topk.max_score(best, Q, np.arange(40) * 10, X[a : a + 700], np.arange(3000)[a : a + 700])
    for i in range(40):
        scored = sorted((-s, j) for j, s in enumerate(X @ Q[i]) if j != i * 10)[:5]
        assert [(-s, j) for s, j in zip(best.score[best.q == i], best.id[best.q == i])] == scored
    assert best.products < 0.9 * 40 * 3000 * 16  # fewer multiplications than all products


def brute_near(items, k, percent):
    sets = {}
    for i, t in items:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def edited(text, seed, share):
    rng, w = np.random.default_rng(seed), text.split(" ")
    for j in rng.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[j] = f"new{seed}x{j}"
    return " ".join(w)


def test_near_duplicates(spark, fixture_rows, monkeypatch):
    from loomgraph.llm import linking

    base = prose(9, 200)
    items = [(i, t) for i, t in fixture_rows if t is None or len(t) < 60000]
    items += [(1000 + s, edited(base, s, 0.005 + 0.003 * (s % 8))) for s in range(60)] + [(999, base), (998, base.upper())]
    items += [(2000 + s, edited(edited(base, 1, 0.02), 100 + s, 0.01)) for s in range(20)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "doc_id long, text string, n long, id long").repartition(4)
    want = brute_near(items, 3, 85)
    assert rows(neardup.near_duplicates(spark, df), "doc_id", "n_shingles", "component_id", "kept") == want
    monkeypatch.setattr(linking, "CHUNK", 8)
    monkeypatch.setattr(linking, "MASS", 4000)
    assert rows(neardup.near_duplicates(spark, df), "doc_id", "n_shingles", "component_id", "kept") == want
    kept = neardup.drop_near_duplicates(spark, df)
    assert rows(kept, "doc_id") == {(i,) for i, _, c, _ in want if i == c} and kept.columns == df.columns
    twice = df.where("doc_id = 999").unionByName(df.where("doc_id = 999")).unionByName(spark.createDataFrame([(None, "a b c", 1, 2)], df.schema))
    assert rows(neardup.near_duplicates(spark, twice), "doc_id", "component_id", "kept") == {(999, 999, True), (None, None, True)}
    assert neardup.near_duplicates(spark, empty(spark)).count() == 0


def test_near_duplicates_real(spark):
    items = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(neardup.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet")), "doc_id", "n_shingles", "component_id", "kept") == brute_near(items, 3, 85)


def test_substring(spark):
    passage, inline = prose(21, 60), ". ".join(prose(30 + k, 9) for k in range(7)) + "."
    near = edited(passage, 5, 0.02)
    clean = {i: prose(300 + i, 80) + "\n" + prose(400 + i, 12) for i in range(10)}
    heading = "the same short heading of seven words"
    items = {**{i: heading + "\n" + t for i, t in clean.items()}, 20: f"{prose(50, 40)}\n{passage}\n{prose(51, 30)}", 21: f"{prose(52, 35)}\n{passage}", 22: f"{near}\n{prose(53, 30)}", 30: f"{prose(54, 40)}. {inline} {prose(55, 40)}", 31: f"{prose(56, 33)}. {inline} {prose(57, 60)}", 40: passage, 50: None, 51: "", 52: "\n\n"}
    df = spark.createDataFrame([(i, t, 1, len(t or "")) for i, t in items.items()], "doc_id long, text string, start int, n_chars int").repartition(3)
    got = substring.repeated_passages(spark, df).collect()
    assert sorted(r.doc_id for r in got) == [21, 22, 31, 40]
    by_doc = {r.doc_id: r for r in got}
    for d in (21, 22, 40):
        assert by_doc[d].first_doc_id == 20
        assert items[d][by_doc[d].start : by_doc[d].end] in (passage, near)
    assert inline[:-1] in items[31][by_doc[31].start : by_doc[31].end + 2]
    out = {r.doc_id: r for r in substring.drop_repeated_passages(spark, df).collect()}
    assert set(out) == set(items) - {40}
    assert all(out[i].text == items[i] and out[i].n_chars == len(items[i]) for i in range(10)) and out[50].text is None
    assert passage not in out[21].text and near not in out[22].text and passage in out[20].text and prose(53, 30) in out[22].text
    assert out[21].n_chars == len(out[21].text)
    assert substring.repeated_passages(spark, empty(spark)).count() == 0


def test_workers_get_small_batches(spark, monkeypatch, tmp_path):
    """No worker, and no executor that feeds it, holds all the texts of a task at once."""
    kept = prose(700, 200)
    df = spark.createDataFrame([(i, f"{prose(1000 + i, 100)} {kept}") for i in range(200)], "doc_id long, text string").coalesce(1)

    def spy(module, name, file):
        inner = getattr(module, name)

        def seen(batches):
            def noted():
                for batch in batches:
                    with open(file, "a") as f:
                        print(batch.nbytes, file=f)
                    yield batch

            yield from inner(noted())

        monkeypatch.setattr(module, name, seen)

    monkeypatch.setattr(substring, "BATCH", 1 << 16, raising=False)
    for name in ("_units", "_found"):
        spy(substring, name, str(tmp_path / name))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert substring.repeated_passages(spark, df).count() >= 199
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    for name in ("_units", "_found"):
        sizes = [int(x) for x in (tmp_path / name).read_text().split()]
        assert sum(sizes) > 4 << 16 and max(sizes) <= 2 << 16


def test_substring_holds_few_bands_on_disk(spark, monkeypatch):
    """Band keys are counted a few bands at a time, and gone from the disk when the paragraphs are compared."""
    text = prose(801, 400).split(" ")
    rows_ = [(i, " ".join(w if (k + 7 * i) % 61 else f"edit{i}" for k, w in enumerate(text))) for i in range(8)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    counted, stored = [], []
    write = substring.Scratch.write

    def seen(self, table, name, *args, **kwargs):
        out = write(self, table, name, *args, **kwargs)
        if name == "shared":
            counted.append({(r.key & 31) >> 1 for r in out.select("key").collect()})
        if name == "lines":
            for file in Path(self.path.removeprefix("file://")).rglob("*.parquet"):
                part = pq.read_table(file, partitioning=None)
                stored.extend(c for c in part.column_names if c.startswith("bands") and part[c].null_count < part.num_rows)
        return out

    monkeypatch.setattr(substring.Scratch, "write", seen)
    assert {r.doc_id for r in substring.repeated_passages(spark, df).collect()} == set(range(1, 8))
    assert set.union(*counted) == set(range(substring.BANDS)) and max(map(len, counted)) <= substring.BANDS // 3
    assert stored == []


def brute_repeated(items, size=substring.RUN):
    """doc -> words covered by a window of `size` words that an earlier place has and does not overlap."""
    seen, covered = {}, {i: set() for i in items}
    for i in sorted(items):
        words = (items[i] or "").encode().lower().split()
        for k in range(len(words) - size + 1):
            first = seen.setdefault(b" ".join(words[k : k + size]), (i, k))
            if first[0] != i or k - first[1] >= size:
                covered[i].update(range(k, k + size))
    return covered


def test_substring_any_layout(spark):
    passage = prose(61, 60).split()
    spliced = lambda a, b, sep: f"{prose(a, 45)} {sep.join(passage)} {prose(b, 45)}"
    verse = "\n".join(" ".join(passage[k : k + 3]) for k in range(0, 60, 3))
    items = {1: spliced(70, 71, " "), 2: spliced(72, 73, " "), 3: prose(74, 20) + "\n" + verse + "\n" + prose(75, 20), 4: prose(76, 9) + " " + "\n".join([" ".join(passage[:23]), " ".join(passage[23:])]), 5: "word " * 100, 6: None}
    items |= {100 + r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.createDataFrame(list(items.items()), "doc_id long, text string").repartition(3)
    want, got = brute_repeated(items), {i: set() for i in items}
    for r in substring.repeated_passages(spark, df).collect():
        starts = [m.start() for m in re.finditer(r"[^\x20\t-\r]+", items[r.doc_id])]
        got[r.doc_id].update(k for k, a in enumerate(starts) if r.start <= a < r.end)
    assert all(want[i] <= got[i] for i in items)
    assert all(want[i] == got[i] for i in items if i < 100) and len(want[2]) == len(want[3]) == len(want[4]) == 60


def test_substring_gaps_stay(spark):
    """Words between two passages stay, and short pieces of different documents do not add up."""
    a, b, x, y = prose(81, 40), prose(82, 40), prose(83, 30), prose(84, 30)
    items = {1: f"{a} {prose(85, 30)}", 2: f"{b} {prose(86, 30)}", 3: f"{a} six words that nobody else has {b}", 4: f"{x}\n{prose(87, 40)}", 5: f"{y}\n{prose(88, 40)}", 6: f"{x}\n{y}\n{prose(89, 40)}"}
    df = spark.createDataFrame(list(items.items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in substring.drop_repeated_passages(spark, df).collect()}
    assert out[3].strip() == "six words that nobody else has"
    assert all(out[i] == items[i] for i in (1, 2, 4, 5, 6))


def test_substring_bands_miss_little():
    assert (1 - 0.8**substring.ROWS) ** substring.BANDS < 2.1e-4
    h = substring.Words(pa.array([prose(1, 90)])).h
    keys = substring.band_keys([h[:40], h[40:]])
    assert keys.shape == (2, substring.BANDS) and (keys[1] == substring.band_keys([h[40:]])[0]).all()


def test_substring_near_copies_in_any_layout(spark):
    """Edited words, which no verbatim repetition covers, go with their line or, where it is wrapped, with their paragraph."""
    text = prose(401, 600).split(" ")
    other = list(text)
    for k in range(30, 600, 60):
        other[k] = f"changed{k}"
    wrapped = "\n".join(" ".join(other[k : k + 12]) for k in range(0, 600, 12))
    items = {1: f"{prose(402, 50)} {' '.join(text)} {prose(403, 50)}", 2: f"{prose(404, 37)}\n{' '.join(text)}\n{prose(405, 20)}", 3: f"{prose(406, 70)}\n{wrapped}\n{prose(407, 40)}", 4: f"{prose(408, 70)}\n{' '.join(other)}\n{prose(409, 40)}"}
    df = spark.createDataFrame(list(items.items()), "doc_id long, text string")

    def covered(ids):
        out = dict.fromkeys(ids, "")
        for r in substring.repeated_passages(spark, df.where(F.col("doc_id").isin(ids))).collect():
            out[r.doc_id] += items[r.doc_id][r.start : r.end] + " "
        return out

    got = covered([1, 3])
    assert got[1] == "" and got[3].count("changed") >= 2 and len(got[3].split()) >= 500
    got = covered([2, 4])
    assert got[2] == "" and got[4].strip() == " ".join(other)


def test_words_and_paragraphs_of_a_batch():
    """Vectorised over a batch as over each text alone; hashes stand for lower-cased words."""
    odd = ["", "  \n", "Ab ab AB é É\x0b\x0cz", "😀 x\ny" + " w" * 60, "L" * 999 + " l", "l" * 999, prose(3, 700), prose(4, 40) + "\n" + prose(5, 31), "word " * 300, prose(6, 49), ""]
    column = pa.array(["skipped", *odd]).slice(1)
    words = substring.Words(column)
    seen = {}
    for k, text in enumerate(odd):
        a, b = words.bounds[k], words.bounds[k + 1]
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        assert list(zip(words.start[a:b].tolist(), words.end[a:b].tolist())) == want
        for (x, y), h in zip(want, words.h[a:b].tolist()):
            assert seen.setdefault(text[x:y].encode().lower(), h) == h
        alone = substring.Words(pa.array([text]))
        one = substring.anchors(alone.h, alone.bounds)[0]
        every = substring.anchors(words.h, words.bounds)[0]
        assert (every[(every >= a) & (every < b)] - a).tolist() == one.tolist()
        own, cut = substring.paragraphs(alone), substring.paragraphs(words)
        mine = (cut[0] >= a) & (cut[0] < b)
        assert [(x[mine] - a).tolist() for x in cut[:2]] == [x.tolist() for x in own[:2]] and cut[2][mine].tolist() == own[2].tolist()
        if b - a >= substring.RUN:
            pieces = [(x, y) for x, y, line in zip(*own) if not line]
            assert [x for x, _ in pieces] == [0] + [y for _, y in pieces[:-1]] and pieces[-1][1] == b - a
    assert len(set(seen.values())) == len(seen)


def test_spanning_links_connect_what_all_links_do():
    from loomgraph.llm import linking

    rng = np.random.default_rng(7)
    for _ in range(30):
        left, right = rng.integers(0, 12, 20), rng.integers(6, 20, 15)
        linked = (rng.random((20, 15)) < 0.08) & (left[:, None] != right[None, :])

        def groups(pairs):
            parent = {int(v): int(v) for v in np.concatenate([left, right])}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, j in pairs:
                a, b = find(int(left[i])), find(int(right[j]))
                parent[max(a, b)] = min(a, b)
            return {v: find(v) for v in parent}

        chosen = linking.spanning(linked, left, right)
        assert all(linked[i, j] for i, j in chosen) and len(chosen) < 20
        assert groups(chosen) == groups(np.argwhere(linked))


def test_clashing_names_null_and_repeated_ids(spark):
    """Columns named like those the operators join on; null ids; repeated rows."""
    names = "gone_doc, gone_t, _gone, cut_doc, cut_t, cut_spans, _spans, _t, _doc, pii_key, pii_cuts, _key, _cuts, key, t, id, component"
    text, passage = prose(501, 50) + " me.x@mail.org", prose(502, 60)
    rows_ = [(None, text), (None, text), (3, text), (4, f"{prose(503, 40)} {passage}"), (5, f"{prose(504, 40)} {passage} ü@ü x@y.zz"), (5, f"{prose(504, 40)} {passage} ü@ü x@y.zz"), (6, None), (7, "")]
    extra = [f"{c} string" for c in names.split(", ")]
    df = spark.createDataFrame([(i, t, *names.split(", ")) for i, t in rows_], f"doc_id long, text string, {', '.join(extra)}")
    own = tuple(names.split(", "))
    for out in (neardup.drop_near_duplicates(spark, df), substring.drop_repeated_passages(spark, df), pii.sanitise(spark, df)):
        assert out.columns == df.columns and all(tuple(r)[2:] == own for r in out.collect())
    kept = sorted(((r.doc_id, r.text) for r in neardup.drop_near_duplicates(spark, df).collect()), key=str)
    assert kept == sorted(((i, t) for i, t in rows_ if i is not None), key=str)
    assert rows(neardup.near_duplicates(spark, df.where("doc_id is null or doc_id = 3")), "doc_id", "component_id", "kept") == {(None, 3, False), (3, 3, True)}
    cut = {(r.doc_id, r.text) for r in substring.drop_repeated_passages(spark, df).collect()}
    assert len([1 for i, t in cut if i == 5]) == 1 and all(passage not in t for i, t in cut if i == 5) and (4, rows_[3][1]) in cut


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    found = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[name]:
                found.append((m.start(), k, m.end(), name))
    return [(f"{name}:{a}:{b}", name) for a, _, b, name in sorted(found)]


def test_pii_base(spark):
    odd = ["a@b.c", "x a@b.com_x@y.de.fr z", "a@b", "@b.c", "é😀 me@x.io 1.2.3.4.5 001.002.3.0255 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112 41111111111111113333333", "+1 (386) 555-3733 +1 22", "12  34 5--6", "+12345678901234567", None, "", "tel +49 30 1234567. 4041894974608795,a.b+c%d@e-f.gh.ij", "9" * 3000 + "@" + "a." * 3000 + "b", "." * 2000, "4041894974608795 4041894974608795", "1.1.1.1\n2.2.2.2 +1 234 567 8901 x"]
    items = list(enumerate(odd + odd[:3]))
    items += [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[0-9]|@'").collect()]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in items], "doc_id long, text string, key string, start int").repartition(3)
    got = {r.doc_id: r for r in pii.find_spans(spark, df).collect()}
    assert len(got) == len(items)
    for i, t in items:
        want = brute_base(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(s for s, _ in want).encode()).hexdigest(), t
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(n == k for _, n in want) for k in ("email", "ip", "card", "phone"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s, _ in want]
    assert pii.find_spans(spark, empty(spark)).count() == 0


def test_pii_terms(spark):
    told = [(i, f"{prose(i, 20)} zorblatt me.x@mail.org {prose(i + 50, 20)}") for i in range(5)]
    plain = [(100 + i, prose(200 + i, 60)) for i in range(60)] + [(200, "only Zorblatt here"), (201, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in told + plain], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in pii.find_spans(spark, df).collect()}
    for i, t in told:
        a = t.index("zorblatt")
        assert f"term:{a}:{a + 8}" in got[i].spans and got[i].n_email == 1 and got[i].n_term == 1
    assert got[200].spans == "term:5:13"
    assert all(not got[i].spans for i, _ in plain if i < 200)
    clean = {r.doc_id: r for r in pii.sanitise(spark, df).collect()}
    assert "me.x@mail.org" not in clean[0].text and "[EMAIL]" in clean[0].text and "zorblatt" not in clean[0].text
    assert clean[0].n_chars == len(clean[0].text) and clean[201].text is None
    assert all(clean[i].text == t for i, t in plain if i < 200)
    one = spark.createDataFrame([(1, "secretword a@b.co")] * 5, "doc_id long, text string")
    assert rows(pii.find_spans(spark, one), "spans") == {("email:11:17",)}  # copies of one text are no evidence


def test_pii_releases_the_driver(spark, monkeypatch):
    """What finished steps hold on the driver goes while the next ones run."""
    steps, write, release = [], pii.Scratch.write, pii.Scratch.release
    monkeypatch.setattr(pii.Scratch, "write", lambda self, df, name, *a, **b: steps.append(name) or write(self, df, name, *a, **b))
    monkeypatch.setattr(pii.Scratch, "release", lambda self: steps.append("") or release(self))
    docs = spark.createDataFrame([(k, f"mail a{k % 3}@b.org now", k) for k in range(9)], "doc_id long, text string, n_chars long")
    assert {r.text for r in pii.sanitise(spark, docs).collect()} == {"mail [EMAIL] now"}
    at = [k for k, name in enumerate(steps) if not name]
    assert [steps[k - 1] for k in at if steps[k - 1]] == ["base", "near", "flagged", "terms", "cuts"]


def test_release_returns_native_memory(spark):
    """What the driver's JVM has freed outside its heap goes back to the system, though other threads' pieces lie between."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    jvm.System.gc()
    held = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for k, deflater in enumerate(held):
        if k % 50:
            deflater.end()
    jvm.System.gc()
    before = resident()
    pii.Scratch(spark, "native").release()
    assert before - resident() > 60
    for deflater in held:
        deflater.end()


def test_pii_shuffles_no_text_without_need(spark, monkeypatch):
    """Texts of entities and of terms are picked by broadcast hashes, whatever Spark's own size check says."""
    told = [(i, f"{prose(i, 20)} zorblatt me.x@mail.org {prose(i + 50, 20)}") for i in range(5)]
    df = spark.createDataFrame(told + [(100 + i, prose(200 + i, 60)) for i in range(60)] + [(200, "only Zorblatt here")], "doc_id long, text string")
    plans, write = {}, pii.Scratch.write

    def seen(self, frame, name, **options):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return write(self, frame, name, **options)

    monkeypatch.setattr(pii.Scratch, "write", seen)
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = rows(pii.find_spans(spark, df), "doc_id", "spans", "n_term")
        assert all("BroadcastHashJoin" in plans[name] for name in ("some", "terms"))
        monkeypatch.setattr(pii, "FEW", 0)
        assert rows(pii.find_spans(spark, df), "doc_id", "spans", "n_term") == few
        assert not any("BroadcastHashJoin" in plans[name] for name in ("some",))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    assert (200, "term:5:13", 1) in few and sum(n for _, _, n in few) == 6


def test_pii_terms_of_rare_entities(spark):
    """Two texts are enough if the term is as rare; short names and far places count; the words of a single text do not."""
    told = [(i, f"Lee {prose(i, 60)} me.x@mail.org {prose(i + 50, 20)}") for i in range(2)] + [(2, f"alone {prose(90, 20)} you@mail.org")]
    plain = [(100 + i, prose(200 + i, 30)) for i in range(4000)]
    df = spark.createDataFrame(told + plain, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.find_spans(spark, df).where("spans <> ''").collect()}
    assert set(got) == {0, 1, 2}
    assert [got[i].n_term for i in range(3)] == [1, 1, 0]
    assert all(got[i].spans.startswith("term:0:3,email:") for i in range(2))


def test_token_counts(spark, docs, fixture_rows):
    scores = token_counts.unigram(token_counts.default_model())
    trie = token_counts.Trie(scores)

    def brute(token):
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            options = [(best[s][0] + scores[token[s:end]], best[s][1] - 1) for s in range(end) if token[s:end] in scores]
            if token[end - 1] not in scores:
                n = len(token[end - 1].encode())
                options.append((best[end - 1][0] + trie.unknown * n, best[end - 1][1] - n))
            best.append(max(options))
        return -best[-1][1]

    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    seen = {}
    for doc_id, text in fixture_rows:
        chunks = ["▁" + c for c in (text or "").split()]
        assert got[doc_id] == sum(seen.setdefault(c, brute(c)) if c in seen else seen.setdefault(c, brute(c)) for c in chunks)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_audio(spark, docs, fixture_rows):
    got = {r.doc_id: r for r in audio.media_features(spark, docs).collect()}
    by_text = {}
    for doc_id, text in fixture_rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 16000, 0, "NONE", ""))
            w.writeframes(payload)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(out.getvalue()))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(out.getvalue()).hexdigest()
        assert by_text.setdefault(text or "", r.feature) == r.feature
    assert audio.media_features(spark, empty(spark)).count() == 0


def test_audio_parts(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=777).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        h = audio.phases(up, down)[:, ::-1].T.reshape(-1)
        padded = np.zeros(len(x) * up)
        padded[::up] = x
        want = np.convolve(padded, h)[: len(padded)][::down]
        assert np.allclose(audio.resample(x, up, down), want[: -(-len(x) * up // down)], atol=1e-4)
    assert audio.segments(np.array([0, 0, 1, 0, -1, 0, 1, 1.0]) * 1.0) == [(2, 4), (6, 8)]
    clips = audio.log_mel_clips(audio.store_media(docs)).toArrow()
    tensors = audio.tensor_table(clips)
    assert tensors["tensor"].chunk(0).to_numpy_ndarray().shape[1:] == (audio.FRAMES, audio.MELS)
    assert all(b > a for a, b in zip(clips["start_ms"].to_pylist(), clips["end_ms"].to_pylist()))


def test_audio_stores_clips(spark, docs, fixture_rows, monkeypatch):
    """The query writes every document's clips to the shared folder and reads its features from them."""
    tables = {}
    write = audio.Scratch.write
    monkeypatch.setattr(audio.Scratch, "write", lambda self, df, name, **options: tables.setdefault(name, write(self, df, name, **options)))
    got = {r.doc_id: r.feature for r in audio.media_features(spark, docs).collect()}
    stored = {r.doc_id: r for r in tables["clips"].collect()}
    assert set(stored) == {i for i, _ in fixture_rows}
    for doc_id, text in fixture_rows[::5] + fixture_rows[-13:]:
        mels, energy = audio.analyse(audio.payload_of(text or ""))
        r = stored[doc_id]
        read = np.array([np.frombuffer(c.tensor, "<f2") for c in r.clips])
        assert read.shape == (-(-len(mels) // audio.FRAMES), audio.FRAMES * audio.MELS)
        assert np.array_equal(read.reshape(-1, audio.MELS)[: len(mels)], mels.astype("<f2")) and (read.reshape(-1, audio.MELS)[len(mels) :] == audio.FLOOR).all()
        assert len(r.segments) == len(audio.segments(energy)) and got[doc_id].startswith(f"frames={len(mels)};segments={len(r.segments)};")
