"""Media columns: log-mel features of 8-bit audio, as fixed-shape tensors with time spans.

A payload of bytes is stored losslessly as mono 8-bit PCM in a WAV container. Stored media are read back, resampled by
a polyphase windowed-sinc filter, framed with overlap, and turned into log-mel filterbanks; frame energies are
segmented with hysteresis (a segment opens above the high level and closes below the low one). Clips of FRAMES
frames become tensors of the fixed shape [FRAMES, MELS] in half precision, padded with the floor value, each with its
time span. The samples and frames of one medium are held at once; media are worked on one by one and clips leave in
bounded batches, so memory follows the longest text.

Defined results: null texts are empty and give 64 zero bytes; equal texts give equal values, as no result depends on
other rows; repeated rows repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import texts
from loomgraph.session import Scratch

RATE, UP, DOWN, TAPS = 16000, 2, 3, 16  # input rate; resampled to RATE * UP / DOWN; taps of each phase
WINDOW, HOP, FFT, MELS, FRAMES = 200, 80, 256, 24, 64
FLOOR, HIGH, LOW = -8.0, 0.25, -0.25  # log-mel floor; hysteresis levels about the mean log energy
CHUNK = 4096  # frames worked on at once


def payload_of(text: str, multiple: int = 64) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(multiple, -(-len(raw) // multiple) * multiple) - len(raw))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


@functools.cache
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase bank [up, taps] of a Hann-windowed sinc low-pass, taps reversed for a sliding product."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """y[n] = sum_k h[phase + k*up] x[n*down // up - k], with zeros before the start."""
    bank = phases(up, down, taps)
    total = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(down, np.float32)])
    y = np.empty(total, np.float32)
    for r in range(up):  # outputs n = r, r + up, ... share a phase
        n = len(range(r, total, up))
        windows = np.lib.stride_tricks.sliding_window_view(padded, taps)[r * down // up :: down][:n]
        y[r::up] = windows @ bank[(r * down) % up]
    return y


@functools.cache
def mel_bank() -> np.ndarray:
    """[FFT/2 + 1, MELS] triangles, evenly spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    rising, falling = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rising, falling)).astype(np.float32)


def log_mel(y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-mel [n, MELS], log energy [n]) of the overlapping frames, CHUNK at a time; the last frame is padded."""
    count = max(1, -(-(len(y) - WINDOW) // HOP) + 1)
    y = np.concatenate([y, np.zeros((count - 1) * HOP + WINDOW - len(y), np.float32)]) if (count - 1) * HOP + WINDOW > len(y) else y
    hann = np.hanning(WINDOW).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:count]
    for at in range(0, count, CHUNK):
        part = frames[at : at + CHUNK] * hann
        spectrum = np.fft.rfft(part, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mels = np.maximum(np.log10(power.astype(np.float32) @ mel_bank() + np.float32(10.0**FLOOR)), FLOOR)
        yield mels, np.log10((part * part).mean(1) + np.float32(1e-8))


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame ranges by hysteresis about the mean: opened at >= mean + high, closed at < mean + low."""
    rel = energy - energy.mean()
    mark = np.where(rel >= high, 1, np.where(rel < low, -1, 0))
    at = np.nonzero(mark)[0]
    kind = mark[at]
    first = np.ones(len(at), bool)
    first[1:] = kind[1:] != kind[:-1]
    at, kind = at[first], kind[first]
    starts = at[kind == 1]
    ends = at[kind == -1]
    ends = ends[ends > starts[0]] if len(starts) else ends[:0]
    return [(int(s), int(ends[k]) if k < len(ends) else len(energy)) for k, s in enumerate(starts)]


def analyse(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    parts = list(log_mel(resample(x)))
    return np.concatenate([m for m, _ in parts]), np.concatenate([e for _, e in parts])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [to_wav(payload_of(t.as_py())) for t in batch.column(1)]
        sizes = [len(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV)."""
    return texts(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


SMALL = {"parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}  # small row groups bound a task's memory
STEP_MS = 1000.0 * HOP / (RATE * UP / DOWN)
CLIP = "clip int, start_ms double, end_ms double, active double, tensor binary"  # little-endian half floats, row by row


def clips_of(payload: bytes) -> tuple[list[tuple[int, float, float, float, np.ndarray]], list[tuple[int, int]]]:
    """The clips of a payload, (clip, start_ms, end_ms, share of active frames, tensor [FRAMES, MELS]), and its segments."""
    mels, energy = analyse(payload)
    spans = segments(energy)
    active = np.zeros(len(mels), bool)
    for a, b in spans:
        active[a:b] = True
    clips = []
    for k, at in enumerate(range(0, len(mels), FRAMES)):
        part = mels[at : at + FRAMES]
        tensor = np.full((FRAMES, MELS), FLOOR, "<f2")
        tensor[: len(part)] = part
        clips.append((k, at * STEP_MS, (at + len(part)) * STEP_MS, float(active[at : at + FRAMES].mean()), tensor))
    return clips, spans


def _clip_columns(clips: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
    return [*(pa.array([c[k] for c in clips], kind) for k, kind in enumerate(kinds)), pa.array([c[4].tobytes() for c in clips], pa.binary())]


_NAMES = ["clip", "start_ms", "end_ms", "active", "tensor"]
_STORED = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_ms: double, end_ms: double>>, clips array<struct<{CLIP.replace(' ', ': ').replace(',:', ',')}>>"


PORTION = 2 << 20  # bytes of media (or, read back, of tensors) at once, one medium at least


def _portions(batch: pa.RecordBatch, sized: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, bounded by the bytes of one of its columns."""
    at, held, sizes = 0, 0, pa.compute.binary_length(sized).to_numpy() if pa.types.is_binary(sized.type) else np.diff(sized.offsets.to_numpy()) * (2 * FRAMES * MELS)
    for k, n in enumerate(sizes):
        if k > at and held + n > PORTION:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _portions(whole, whole.column(2)):
            out: list[list] = [[] for _ in range(6)]
            clips: list[tuple] = []
            ends = [0]
            for cell in batch.column(2):
                media = cell.as_py()
                payload = from_wav(media)
                found, spans = clips_of(payload)
                clips += found
                ends.append(len(clips))
                times = [{"start_ms": a * STEP_MS, "end_ms": b * STEP_MS} for a, b in spans]
                for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), times)):
                    column.append(value)
            times = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), times)
            nested = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(_clip_columns(clips), _NAMES))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "clips"]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds)), nested], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _portions(whole, whole.column("clips"))):
        features = []
        for times, clips in zip(batch.column("segments").to_pylist(), batch.column("clips")):
            rows = pa.Table.from_struct_array(clips.values)
            tensors = tensor_table(rows)["tensor"].combine_chunks()
            tensors = tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors
            frames = round(rows["end_ms"][-1].as_py() / STEP_MS)
            mels = tensors.to_numpy_ndarray().reshape(-1, MELS)[:frames].astype(np.float32)
            active = sum(round((s["end_ms"] - s["start_ms"]) / STEP_MS) for s in times)
            coarse = np.round(mels * 4).astype(np.int8)
            features.append(f"frames={frames};segments={len(times)};active={active};mel={','.join(f'{v:.2f}' for v in mels.mean(0)[:: MELS // 4])};crc={zlib.crc32(coarse.tobytes())}")
        kept = batch.select([n for n in batch.schema.names if n not in ("segments", "clips")])
        yield pa.record_batch([*kept.columns, pa.array(features, pa.string())], names=[*kept.schema.names, "feature"])


def stored_clips(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Media in the shared folder, and from those read back, one row a document: payload and medium, segments, and clips with
    their spans and tensors, in the shared folder too."""
    stored = scratch.write(store_media(docs), "media")
    return scratch.write(stored.mapInArrow(_stored, _STORED), "clips", **SMALL)


def media_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store media and clips in the shared folder, and summarise payload, medium and features from those read back."""
    stored = stored_clips(Scratch(spark, "media"), docs)
    return stored.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(2)):
            clips, _ = clips_of(from_wav(cell.as_py()))
            yield pa.record_batch([pa.array([doc_id] * len(clips), pa.int64()), *_clip_columns(clips)], names=["doc_id", *_NAMES])


def log_mel_clips(media: DataFrame) -> DataFrame:
    """One row per clip of a table (doc_id, n_bytes, media): its span, share of active frames, and tensor."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_clips, f"doc_id long, {CLIP}")


def tensor_table(table: pa.Table) -> pa.Table:
    """An Arrow table of clips with `tensor` as the fixed-shape tensor type [FRAMES, MELS]."""
    flat = table["tensor"].combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    values = np.frombuffer(b"".join(flat.to_pylist()), "<f2")
    kind = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS), dim_names=("frame", "mel"))
    sized = pa.FixedSizeListArray.from_arrays(pa.array(values, pa.float16()), FRAMES * MELS)
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, sized))
