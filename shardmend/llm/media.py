"""Media columns: 8-bit audio stored losslessly, its log-mel tensors and active spans.

``store_audio`` wraps payload bytes as a mono 8-bit PCM WAV file. ``audio_features`` reads such files back: polyphase
resampling, overlapped log-mel frames and hysteresis segmentation. The frames are cut into patches of one fixed shape
and kept as an Arrow IPC stream with a fixed-shape tensor column and the time span of each patch.

Null text counts as empty; an empty payload is padded to one unit of 64 zero bytes. Long payloads are read in blocks,
so that working memory does not grow with them. Rows that repeat a text have equal payloads, bytes and features. An empty
table gives no rows. Columns are carried along under any names, but for those that a function makes, which it replaces.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import arrow_map

UNIT = 64
RATE, UP, DOWN, TAPS = 8000, 2, 3, 16
WIN, HOP, MELS, PATCH = 256, 128, 16, 32
#: Hysteresis in dB below the loudest frame: a span opens above OPEN and closes under CLOSE.
OPEN, CLOSE = -3.0, -6.0
BLOCK_FRAMES = 2048
FEATURE_SCHEMA = "payload binary, n_frames int, tensor binary, spans array<struct<start_s:double,end_s:double>>, level_db array<float>"


def padded_payload(text: Column) -> Column:
    """UTF-8 bytes of a text with zero bytes up to a positive multiple of the unit."""
    b = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    units = F.greatest(F.ceil(F.length(b) / F.lit(UNIT)), F.lit(1))
    return F.concat(b, F.unhex(F.repeat(F.lit("00"), (units * UNIT - F.length(b)).cast("int"))))


def wav(payload: bytes) -> bytes:
    """A RIFF file of one format chunk and one data chunk, 8-bit mono."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def unwav(stored: bytes) -> bytes:
    """The data chunk of a RIFF file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase low-pass bank (UP rows of TAPS), mel bank (bins by MELS), window."""
    t = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(t * cut) * cut * np.hanning(UP * TAPS + 2)[1:-1]
    bank = (h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1]
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WIN, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return bank.astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32), np.hanning(WIN).astype(np.float32)


BANK, MEL_BANK, WINDOW = _filters()


def resampled(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Outputs ``start`` to ``stop`` of the signal at UP/DOWN times its rate; silence around it."""
    n = np.arange(start, stop)
    base, phase = (n * DOWN) // UP, (n * DOWN) % UP
    low, high = int(base[0]) - TAPS + 1, int(base[-1]) + 1
    x = np.zeros(high - low, np.float32)
    a, b = max(low, 0), min(high, len(samples))
    if b > a:
        x[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(len(n), np.float32)
    for p in range(UP):
        at = phase == p
        out[at] = windows[base[at] - base[0]] @ BANK[p]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and the level of each frame in dB."""
    length = -(-len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(length - WIN) // HOP))
    mels, level = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for f0 in range(0, frames, BLOCK_FRAMES):
        f1 = min(frames, f0 + BLOCK_FRAMES)
        x = resampled(samples, f0 * HOP, (f1 - 1) * HOP + WIN)
        w = np.lib.stride_tricks.sliding_window_view(x, WIN)[::HOP]
        power = np.abs(np.fft.rfft(w * WINDOW, axis=1)).astype(np.float32) ** 2
        mels[f0:f1] = np.log(power @ MEL_BANK + 1e-6)
        level[f0:f1] = 10 * np.log10((w * w).mean(axis=1) + 1e-10)
    return np.round(mels, 2), np.round(level, 1)


def active_spans(level: np.ndarray) -> list[tuple[int, int]]:
    """Frames [a, b) of each span: it opens above one threshold and closes under a lower one."""
    top = level.max()
    state = np.where(level >= top + OPEN, 1, np.where(level < top + CLOSE, 0, -1))
    state[0] = max(state[0], 0)
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
    on = np.concatenate([[0], state[known], [0]])
    edge = np.flatnonzero(np.diff(on))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS], dim_names=["frame", "mel"])
TENSOR_SCHEMA = pa.schema([("patch", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])
FRAME_S = HOP * DOWN / (RATE * UP)


def tensor_stream(mels: np.ndarray) -> bytes:
    """Patches of one shape (the last filled up with the floor) as an Arrow IPC stream."""
    patches = -(-len(mels) // PATCH)
    cube = np.full((patches * PATCH, MELS), np.float32(round(np.log(1e-6), 2)), np.float32)
    cube[: len(mels)] = mels
    at = np.arange(patches) * PATCH
    columns = [
        pa.FixedShapeTensorArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(cube.ravel(), PATCH * MELS)),
        pa.array(at * FRAME_S),
        pa.array(np.minimum(at + PATCH, len(mels)) * FRAME_S),
    ]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSOR_SCHEMA))
    return sink.getvalue().to_pybytes()


def _with(batch: pa.RecordBatch, columns: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    new = dict(columns)
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n not in new), *new.values()], names=[*(n for n in batch.schema.names if n not in new), *new])


def _schema(df: DataFrame, more: str) -> str:
    new = {x.split()[0] for x in more.replace(", ", "\n").split("\n")}
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c not in new), more])


def store_audio(df: DataFrame, payload: str = "payload", out: str = "wav") -> DataFrame:
    """``df`` with column ``out``: each payload as a WAV file. A column of that name is replaced."""
    f = lambda batch: _with(batch, [(out, pa.array([wav(x or b"") for x in batch.column(payload).to_pylist()], pa.binary()))])
    return arrow_map(df, f, _schema(df, f"{out} binary"))


def audio_features(df: DataFrame, stored: str = "wav") -> DataFrame:
    """``df`` with the payload read back from ``stored`` and its features; columns of those names are replaced."""

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        payloads, tensors, spans, levels, frames = [], [], [], [], []
        for x in batch.column(stored).to_pylist():
            payload = unwav(x)
            mels, level = log_mel(np.frombuffer(payload, np.uint8))
            payloads.append(payload)
            tensors.append(tensor_stream(mels))
            spans.append([{"start_s": a * FRAME_S, "end_s": b * FRAME_S} for a, b in active_spans(level)])
            levels.append(level)
            frames.append(len(mels))
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        return _with(batch, [("payload", pa.array(payloads, pa.binary())), ("n_frames", pa.array(frames, pa.int32())), ("tensor", pa.array(tensors, pa.binary())), ("spans", pa.array(spans, span)), ("level_db", pa.array(levels, pa.list_(pa.float32())))])

    return arrow_map(df, features, _schema(df, FEATURE_SCHEMA))


def media_digest(df: DataFrame) -> DataFrame:
    """One row for each document: digests of its stored audio, of the payload read back and of the features."""
    docs = df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), padded_payload(F.col("text")).alias("payload"))
    done = audio_features(store_audio(docs))
    feature = F.concat_ws(":", "n_frames", F.size("spans"), F.round(F.aggregate("spans", F.lit(0.0), lambda a, s: a + s.end_s - s.start_s), 3), F.sha2("tensor", 256))
    return done.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -UNIT, UNIT)).alias("tail_crc32"), F.length("wav").cast("long").alias("media_bytes"),
        F.sha2("wav", 256).alias("media_sha256"), feature.alias("feature"), "n_frames", F.size("spans").alias("n_spans"),
    )
