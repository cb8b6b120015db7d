"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segmentation.

An audio column holds RIFF/WAVE with unsigned 8-bit mono samples. The features of a clip are one Arrow IPC stream whose
`logmel` column is a fixed-shape tensor (frames x mels) with the span of time of each window, and whose schema
metadata lists the active segments. Everything runs row by row within the partitions of the scan: no shuffle.

Null or empty audio: one window of silence, no segment. Short clips: padded with silence to one window. A very long clip is
worked on whole, in arrays of some forty times its bytes, one clip at a time. Equal clips and repeated rows give equal
values, one row each; null keys stay null. Empty table: no row. Other columns of the input are ignored."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, texts_of


@dataclass(frozen=True)
class AudioParams:
    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps: int = 24
    window: int = 200
    hop: int = 80
    n_fft: int = 256
    n_mels: int = 16
    frames: int = 32
    step: int = 24  # windows of `frames` overlap by frames - step
    on_db: float = 1.0
    off_db: float = -1.0
    min_frames: int = 3

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def wav_bytes(samples: bytes, rate: int) -> bytes:
    n = len(samples)
    pad = b"\0" * (n % 2)
    return b"RIFF" + struct.pack("<I", 36 + n + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + samples + pad


def wav_samples(data: bytes) -> tuple[int, bytes]:
    """Rate and 8-bit samples, walking the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not RIFF/WAVE")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        if kind == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def _lowpass(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed sinc with taps coefficients for each of the `up` phases; row p is phase p."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = 24) -> np.ndarray:
    """y[m] = sum_k h[phase + k up] x[m down // up - k], phase = m down mod up: only the samples that stay are computed."""
    h = _lowpass(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(down + taps, np.float32)])
    out = np.empty(n, np.float32)
    for r in range(min(up, n)):
        base, phase, count = r * down // up, r * down % up, -(-(n - r) // up)
        acc = np.zeros(count, np.float32)
        for k in range(taps):
            at = taps + base - k
            acc += h[phase, k] * padded[at : at + (count - 1) * down + 1 : down]
        out[r::up] = acc
    return out


@lru_cache(8)
def _mel(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0.0), mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f[None, :] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
    down = (edges[2:, None] - f[None, :]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(y: np.ndarray, p: AudioParams) -> np.ndarray:
    n = max(1, 1 + -(-(len(y) - p.window) // p.hop)) if len(y) > p.window else 1
    padded = np.zeros((n - 1) * p.hop + p.window, np.float32)
    padded[: len(y)] = y[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, p.window)[:: p.hop] * np.hanning(p.window).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, p.n_fft, axis=1)) ** 2
    return (10 * np.log10(power.astype(np.float32) @ _mel(p.n_mels, p.n_fft, p.out_rate) + 1e-6)).astype(np.float32)


def segments(energy_db: np.ndarray, p: AudioParams) -> list[tuple[int, int]]:
    """Frames [a, b) where energy rose over mean + on_db and hadn't yet fallen below mean + off_db."""
    e = energy_db - energy_db.mean()
    event = np.where(e >= p.on_db, 1, np.where(e < p.off_db, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(e)), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if b - a >= p.min_frames]


def features(samples: bytes, p: AudioParams) -> bytes:
    """The Arrow IPC stream of one clip's features."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels = log_mel(resample(x, p.up, p.down, p.taps), p)
    n = len(mels)
    ms = 1000.0 * p.hop / p.out_rate
    spans = [[round(a * ms), round(b * ms)] for a, b in segments(mels.mean(axis=1), p)]
    starts = np.arange(0, max(1, n - p.frames + p.step), p.step)
    full = np.full((int(starts[-1]) + p.frames, p.n_mels), -60, np.float32)
    full[:n] = mels[: len(full)]
    tensor = np.ascontiguousarray(np.stack([full[s : s + p.frames] for s in starts]))
    kind = pa.fixed_shape_tensor(pa.float32(), (p.frames, p.n_mels), dim_names=["frame", "mel"])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.reshape(-1)), p.frames * p.n_mels)
    columns = [pa.ExtensionArray.from_storage(kind, flat), pa.array(np.rint(starts * ms).astype(np.int64)), pa.array(np.rint((starts + p.frames) * ms).astype(np.int64))]
    schema = pa.schema([("logmel", kind), ("start_ms", pa.int64()), ("end_ms", pa.int64())], {"segments_ms": json.dumps(spans), "frames": str(n), "rate": str(p.out_rate)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        w.write_batch(pa.record_batch(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def summary(stream: bytes) -> str:
    """A short line about a stored stream of features, read back from it."""
    t = pa.ipc.open_stream(stream).read_all()
    meta, col = t.schema.metadata, t.column("logmel").combine_chunks()
    values = col.storage.values.to_numpy()
    spans = json.loads(meta[b"segments_ms"])
    kind = t.schema.field("logmel").type
    active = sum(b - a for a, b in spans)
    return f"shape={'x'.join(map(str, kind.shape))};windows={len(t)};frames={meta[b'frames'].decode()};segments={len(spans)};active_ms={active};mean_db={float(values.mean(dtype=np.float64)):.3f};crc={zlib.crc32(np.rint(values * 8).astype('<i4').tobytes()):08x}"


def audio_features(df: DataFrame, key: str, audio: str, params: AudioParams = AudioParams()) -> DataFrame:
    """key, features binary: the Arrow stream of each clip in the WAVE column `audio`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            clips = (wav_samples(x)[1] if x else b"" for x in b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([features(c, params) for c in clips], pa.binary())], names=["key", "features"])

    return map_arrow(df.select(df[key].cast("long").alias("key"), df[audio].alias("audio")), run, "key long, features binary")


def payload(text: str, unit: int = 192) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def text_media(docs: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """One row per document: its text as audio, read back, with digests and features.

    doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
    media_sha256 string, feature string, features binary. Null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                n, samples = payload(text)
                media = wav_bytes(samples, params.rate)
                _, back = wav_samples(media)
                stream = features(back, params)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), summary(stream), stream))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "features"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return map_arrow(texts_of(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, features binary")
