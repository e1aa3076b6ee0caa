"""Operator 7: audio features of a media column.

A payload of bytes is stored as 8-bit PCM in a WAV container, read back, resampled by a polyphase
filter, and turned into overlapped log-mel frames; hysteresis over frame energies finds the active
spans.  Frames are stored as tensors of one fixed shape with their time spans.

Defined results: a null text is an empty payload; an empty payload is padded to one unit, so every row
has media, at least one frame and one tensor; equal texts give equal values; a null ``doc_id`` stays
null; repeated rows each get a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, PAD = 576, 255
RATE, UP, DOWN = 12_000, 2, 3
NEW_RATE = RATE * UP // DOWN
TAPS = 24
FRAME, HOP, FFT, MELS = 200, 80, 256, 20
#: Frames of a tensor.
PATCH = 64
FLOOR = -11.5
#: Hysteresis: a span begins above the first level and ends below the second, in dB of the frame's mean square.
BEGIN_DB, END_DB = -9.0, -12.0
#: Frames that are handled at a time, so that a long payload needs little memory besides itself.
BLOCK = 8_192


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and how many of its bytes are the text's."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT), len(raw)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


@lru_cache(maxsize=1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The resampling filter by phase, the frame window, and the mel filters."""
    n = np.arange(TAPS) - (TAPS - 1) / 2
    low = np.sinc(n / max(UP, DOWN)) * np.hamming(TAPS)
    low *= UP / low.sum()
    phases = low.reshape(-1, UP).T.astype(np.float32)  # [phase, tap]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(NEW_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * NEW_RATE / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resampled_length(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Output samples ``first`` to ``last`` of the rate NEW_RATE; ``samples``: unsigned bytes.

    Output m lies on input m * DOWN / UP; its phase picks the taps, so no zeros are ever multiplied.
    Both bounds must be multiples of UP, but for the end of the signal.
    """
    phases, _, _ = _filters()
    taps = phases.shape[1]
    lo, hi = first * DOWN // UP - taps + 1, (last - 1) * DOWN // UP + 1
    x = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    x[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128) / 128
    out = np.zeros(last - first, np.float32)
    for r in range(UP):
        y = out[r::UP]
        phase, at = (r * DOWN) % UP, (r * DOWN) // UP + taps - 1
        for k in range(taps):
            y += phases[phase, k] * x[at - k : at - k + (len(y) - 1) * DOWN + 1 : DOWN]
    return out


def frame_count(n_samples: int) -> int:
    """Frames that cover every sample; the last one may reach beyond the end."""
    return 1 + -(-max(0, resampled_length(n_samples) - FRAME) // HOP)


def mel_blocks(samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (log-mel frames, mean squares of frames)."""
    _, window, mels = _filters()
    total, length = frame_count(len(samples)), resampled_length(len(samples))
    for f in range(0, total, BLOCK):
        n = min(BLOCK, total - f)
        last = min(f * HOP + (n - 1) * HOP + FRAME, length)
        y = resample(samples, f * HOP, last)
        y = np.pad(y, (0, (n - 1) * HOP + FRAME - len(y)))  # zero level behind the end
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
        power = np.abs(np.fft.rfft(frames * window, FFT, axis=1)).astype(np.float32) ** 2
        yield np.maximum(np.log(power @ mels + 1e-5), np.float32(FLOOR)), np.einsum("ij,ij->i", frames, frames) / FRAME


def hysteresis(db: np.ndarray) -> np.ndarray:
    """Pairs (first frame, frame behind the last) of active spans."""
    state = np.where(db > BEGIN_DB, 1, np.where(db < END_DB, 0, -1))
    state[0] = max(state[0], 0)
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
    on = np.concatenate([[0], state[at], [0]])
    edge = np.diff(on)
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


@dataclass
class Features:
    tensors: pa.FixedShapeTensorArray  # float32 [PATCH, MELS] each
    patch_s: np.ndarray  # float64 [n, 2]
    active_s: np.ndarray  # float64 [k, 2]
    n_frames: int


def extract(payload: bytes) -> Features:
    samples = np.frombuffer(payload, np.uint8)
    parts = list(mel_blocks(samples))
    mel = np.concatenate([p[0] for p in parts])
    db = 10 * np.log10(np.concatenate([p[1] for p in parts]) + 1e-9)
    n = len(mel)
    patches = np.full((-(-n // PATCH), PATCH, MELS), FLOOR, np.float32)
    patches.reshape(-1, MELS)[:n] = mel
    begin = np.arange(len(patches)) * PATCH
    end = np.minimum(begin + PATCH, n)
    length = resampled_length(len(samples))
    seconds = lambda b, e: np.stack([b * HOP / NEW_RATE, np.minimum((e - 1) * HOP + FRAME, length) / NEW_RATE], axis=1)
    spans = hysteresis(db)
    return Features(pa.FixedShapeTensorArray.from_numpy_ndarray(patches), seconds(begin, end), seconds(spans[:, 0], spans[:, 1]), n)


def describe(x: Features) -> str:
    """A short text of the features: counts, active time, mean of each mel band, and the tensors' hash."""
    values = x.tensors.to_numpy_ndarray()
    mean = values.reshape(-1, MELS)[: x.n_frames].mean(axis=0, dtype=np.float64)
    active = float((x.active_s[:, 1] - x.active_s[:, 0]).sum()) if len(x.active_s) else 0.0
    digest = hashlib.sha256(np.ascontiguousarray(values)).hexdigest()[:16]
    return f"frames={x.n_frames};tensors={len(values)}x{PATCH}x{MELS};spans={len(x.active_s)};active={active:.3f};mel=" + ",".join(f"{v:.3f}" for v in mean) + f";sha={digest}"


SPAN = pa.list_(pa.float64(), 2)
#: Columns that the operator can return: Arrow type, Spark type.
COLUMNS = {
    "n_bytes": (pa.int64(), "long"),
    "payload_bytes": (pa.int64(), "long"),
    "payload_sha256": (pa.string(), "string"),
    "tail_crc32": (pa.int64(), "long"),
    "media_bytes": (pa.int64(), "long"),
    "media_sha256": (pa.string(), "string"),
    "feature": (pa.string(), "string"),
    "media": (pa.binary(), "binary"),
    "tensors": (pa.list_(pa.list_(pa.float32())), "array<array<float>>"),
    "tensor_spans": (pa.list_(pa.list_(pa.float64())), "array<array<double>>"),
    "active_spans": (pa.list_(pa.list_(pa.float64())), "array<array<double>>"),
}
DIGESTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _row(text: str | None, columns: tuple[str, ...]) -> dict:
    payload, n = payload_of(text)
    media = to_wav(payload)
    read = from_wav(media)
    x = extract(read)
    row = {
        "n_bytes": n,
        "payload_bytes": len(read),
        "payload_sha256": hashlib.sha256(read).hexdigest(),
        "tail_crc32": zlib.crc32(read[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": describe(x),
    }
    if "media" in columns:
        row["media"] = media
    if "tensors" in columns:
        row["tensors"] = list(x.tensors.to_numpy_ndarray().reshape(len(x.tensors), -1))
    if "tensor_spans" in columns:
        row["tensor_spans"] = x.patch_s.tolist()
    if "active_spans" in columns:
        row["active_spans"] = x.active_s.tolist()
    return row


def audio_features(docs: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """doc_id and ``columns`` for each row of ``docs`` (doc_id, text).

    ``tensors`` has PATCH * MELS values each (see ``as_tensors``), ``tensor_spans`` and ``active_spans``
    begin and end in seconds.  Scale: one pass by partition, no shuffle; rows go out some at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for k in range(0, batch.num_rows, 256):
                rows = [_row(t.as_py(), columns) for t in texts.slice(k, 256)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), *(pa.array([r[c] for r in rows], COLUMNS[c][0]) for c in columns)], ["doc_id", *columns])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {COLUMNS[c][1]}" for c in columns))


def as_tensors(values: pa.ListArray | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """The ``tensors`` of one or more rows as a fixed-shape Arrow tensor array [PATCH, MELS]."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().flatten().cast(pa.float32())
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS]), pa.FixedSizeListArray.from_arrays(flat, PATCH * MELS))
