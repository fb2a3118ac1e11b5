"""Motion-JPEG clips: frames out of AVI payloads, one row each, and ordered frames back into a clip."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.functions.batches import small
from shardmend.plans.recipe import Recipe, apply_recipe

DEFAULT_FPS = 15.0


def chunks(data: bytes, at: int = 12, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, stop) of RIFF chunks, those inside lists too."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        stop = min(at + 8 + size, end)
        if name == b"LIST":
            yield from chunks(data, at + 12, stop)
        else:
            yield name, at + 8, stop
        at = stop + (size & 1)


def demuxed(data: bytes) -> tuple[float, list[bytes]]:
    """Frame rate and frames of a clip; without RIFF structure, whatever lies between SOI and EOI."""
    fps, out = DEFAULT_FPS, []
    if data[:4] == b"RIFF":
        for name, start, stop in chunks(data):
            if name == b"avih" and stop - start >= 4 and (micro := struct.unpack_from("<I", data, start)[0]):
                fps = 1e6 / micro
            elif name[2:] in (b"dc", b"db") and stop > start:
                out.append(data[start:stop])
    if not out:
        at = 0
        while (start := data.find(b"\xff\xd8\xff", at)) >= 0 and (stop := data.find(b"\xff\xd9", start)) >= 0:
            out.append(data[start : stop + 2])
            at = stop + 2
    return fps, out


def muxed(frames: list[bytes], fps: float, width: int, height: int) -> bytes:
    """A minimal AVI file of one video stream with an index of its frames."""
    fps = min(max(fps, 1.0), 240.0)
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) & 1)
    group = lambda name, body: chunk(b"LIST", name + body)
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", round(1e6 / fps), 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1000, round(fps * 1000), 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    pieces, places, at = [], [], 4
    for frame in frames:
        pieces.append(chunk(b"00dc", frame))
        places.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(pieces[-1])
    movie, index = b"".join(pieces), b"".join(places)
    body = b"AVI " + group(b"hdrl", chunk(b"avih", main) + group(b"strl", chunk(b"strh", stream) + chunk(b"strf", form))) + group(b"movi", movie) + chunk(b"idx1", index)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def clip_frames(clips: DataFrame) -> DataFrame:
    """(clip_id, idx, fps, bytes) from (clip_id, bytes)."""
    kind = dict(clips.dtypes)["clip_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for i, data in enumerate(batch.column("bytes").to_pylist()):
                fps, frames = demuxed(data or b"")
                yield pa.RecordBatch.from_arrays([batch.column("clip_id").take(pa.array([i] * len(frames), pa.int64())), pa.array(range(len(frames)), pa.int32()), pa.array([fps] * len(frames), pa.float64()), pa.array(frames, pa.binary())], names=["clip_id", "idx", "fps", "bytes"])

    return clips.select("clip_id", "bytes").mapInArrow(run, f"clip_id {kind}, idx int, fps double, bytes binary")


def clips_of_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(clip_id, n_frames, bytes) from (clip_id, idx, fps, bytes); a clip is one file and so one row."""
    kind = dict(frames.dtypes)["clip_id"]

    def mux(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        whole = muxed(rows.column("bytes").to_pylist(), rows.column("fps")[0].as_py(), width, height)
        return pa.table({"clip_id": rows.column("clip_id").slice(0, 1), "n_frames": pa.array([rows.num_rows], pa.int32()), "bytes": pa.array([whole], pa.binary())})

    return frames.select("clip_id", "idx", "fps", "bytes").groupBy("clip_id").applyInArrow(mux, f"clip_id {kind}, n_frames int, bytes binary")


def framewise(whole: DataFrame, recipe: Recipe) -> DataFrame:
    """(clip_id, idx, fps, bytes): the frames of clips (clip_id, bytes), each through a recipe whose seeds grow with the frame's number."""
    return apply_recipe(clip_frames(whole), recipe, seed="idx")
