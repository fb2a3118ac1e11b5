"""Document fingerprints of statistically improbable features.

Every window of 64 bytes has an entropy; entropies are ranked by how rare they are over all windows of all documents,
rarest first. A window that is the leftmost of best rank in at least POPULAR of the 64 runs of 64 windows around it is a
feature; where no window gets so far, those that got farthest are. The features of a text, in order and without repeats, go into Bloom filters of 2048 bits, 160 to each, chained
as needed. Two digests are alike by the bits that their filters share beyond chance, over the most that could be shared.

Null texts count as empty; an empty text has no features and an empty fingerprint. A text under 64 bytes is one window,
filled up with zero bytes. Equal texts have equal fingerprints, and equal fingerprints a likeness of 1; an empty one and
another have 0. Rows that repeat a doc_id follow each other in order of a hash of their text. A single row is its own
next document. An empty table gives no rows. Other columns are ignored, whatever their names. Ids must be whole numbers. Very long texts are read in
pieces; a task holds rows of WORK_CHARS at once, or a single longer one with the next and its edit.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import materialise, mix64, row_groups, strings, tidied, utf8, whole_id

WINDOW, RUN, POPULAR = 64, 64, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
GRADES = 1001
#: Windows of less than this part of the highest entropy, in thousandths, come after all others.
DULL = 100
PIECE = 1 << 18
#: Bytes of text in a part of the order: as many as give each core some parts, between these bounds.
LEAST_PART, PART_BYTES, PARTS_A_CORE = 16 << 20, 256 << 20, 3
#: Rows and characters that a task works on at once.
WORK_ROWS, WORK_CHARS = 256, 4 << 20
NULL_ID = -(1 << 63)

_G = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * 1024).astype(np.int64)
_STEP = np.diff(_G, prepend=0)
_FULL = 6 * WINDOW * 1024


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of a buffer in thousandths of 6 bits, by its first byte."""
    n = len(data)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        back[lag:] += same
        ahead[:-lag] += same
    # Entering bytes add the step of their count so far, leaving ones take that of their count from there on.
    total = np.cumsum(_STEP[back])
    total[WINDOW:] -= np.cumsum(_STEP[ahead])[:-WINDOW]
    return ((_FULL - total[WINDOW - 1 :]) * (GRADES - 1) // _FULL).astype(np.int16)


def pieces(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of rows or of parts of one: bytes, starts in them, rows, and the positions [a, b) that count in each part.

    Rows under a window are filled up; parts of a long row overlap by what their features depend on.
    """
    for i, j in row_groups(starts, PIECE):
        size = np.diff(starts[i : j + 1])
        if j - i == 1 and size[0] > 2 * PIECE:
            for s in range(0, int(size[0]), PIECE):
                low, high = max(0, s - RUN), min(int(size[0]), s + PIECE + RUN + WINDOW)
                if high - low >= WINDOW:
                    yield data[starts[i] + low : starts[i] + high], np.array([0, high - low]), np.array([i]), np.array([s - low]), np.array([min(s + PIECE, int(size[0])) - low])
            continue
        room = np.where(size > 0, np.maximum(size, WINDOW), 0)
        at = np.concatenate([[0], np.cumsum(room)])
        part = data[starts[i] : starts[j]]
        if at[-1] != len(part):
            filled = np.zeros(at[-1], np.uint8)
            filled[np.arange(len(part)) + np.repeat(at[:-1] - (starts[i:j] - starts[i]), size)] = part
            part = filled
        if len(part):
            yield part, at, np.arange(i, j), np.zeros(j - i, np.int64), room


def windows_of(at: np.ndarray) -> np.ndarray:
    """Whether a window that starts at a byte stays within its row."""
    n = int(at[-1])
    ok = np.ones(n, bool)
    for e in at[1:][np.diff(at) > 0]:
        ok[e - WINDOW + 1 : e] = False
    return ok[: n - WINDOW + 1]


def entropy_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many windows of all documents have each entropy, and the bytes of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRADES + 1, np.int64)
        for batch in batches:
            data, starts = utf8(batch.column(0))
            total[GRADES] += len(data)
            for part, at, _, low, high in pieces(data, starts):
                ok = windows_of(at)
                if len(low) == 1:
                    ok[: low[0]] = False
                    ok[high[0] :] = False
                total[:GRADES] += np.bincount(entropies(part)[ok], minlength=GRADES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GRADES + 1)), pa.array(total)], names=["grade", "n"])

    out = np.zeros(GRADES + 1, np.int64)
    for row in docs.select("text").mapInArrow(count, "grade long, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect():
        out[row["grade"]] = row["n"]
    return out[:GRADES], int(out[GRADES])


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy: rarest first, dull ones last; of equal counts the higher entropy first."""
    dull = np.arange(GRADES) < DULL
    order = np.lexsort((-np.arange(GRADES), counts, dull))
    rank = np.empty(GRADES, np.int64)
    rank[order] = np.arange(GRADES)
    return rank


def popularity(part: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """In how many runs each window of a buffer is the leftmost of best rank."""
    ok = windows_of(at)
    key = np.full(len(part) + RUN, np.iinfo(np.int64).max)
    key[: len(ok)][ok] = (rank[entropies(part)[ok]] << 32) | np.flatnonzero(ok)
    width, least = 1, key
    while width < RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = np.maximum(np.diff(at) - WINDOW + 1, 0)  # windows of each row
    runs = np.where(count > 0, np.maximum(count - RUN + 1, 1), 0)
    first = np.repeat(at[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    # A row of few windows has one run, which may not reach into the next row.
    short = np.flatnonzero((count > 0) & (count < RUN))
    winner = least[first] & 0xFFFFFFFF
    place = np.cumsum(runs) - runs
    for r in short.tolist():
        winner[place[r]] = at[r] + int(np.argmin(key[at[r] : at[r] + count[r]]))
    return np.bincount(winner, minlength=len(part))


def features(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of each row, in order, each once."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(starts) - 1)]
    # How far the windows of a row get is known from all its parts; rows in several are gone through for that first.
    farthest: dict[int, int] = {}
    for part, at, rows, low, high in pieces(data, starts):
        if len(rows) == 1 and high[0] - low[0] < np.diff(starts)[rows[0]]:
            got = popularity(part, at, rank)[low[0] : high[0]]
            farthest[int(rows[0])] = max(farthest.get(int(rows[0]), 0), int(got.max(initial=0)))
    for part, at, rows, low, high in pieces(data, starts):
        popular = popularity(part, at, rank)
        of = np.repeat(np.arange(len(rows)), np.diff(at))
        highest = np.zeros(len(rows), np.int64)
        np.maximum.at(highest, of[popular > 0], popular[popular > 0])
        if len(rows) == 1 and int(rows[0]) in farthest:
            highest[0] = farthest[int(rows[0])]
        chosen = np.flatnonzero((popular > 0) & (popular >= np.minimum(POPULAR, highest[of])))
        r = of[chosen]
        inside = (chosen - at[r] >= low[r]) & (chosen - at[r] < high[r])
        chosen, r = chosen[inside], r[inside]
        views = np.lib.stride_tricks.sliding_window_view(part, WINDOW)[chosen]
        words = np.ascontiguousarray(views).view(np.uint64)
        h = np.zeros(len(words), np.uint64)
        for c in range(words.shape[1]):
            h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[:, c])
        cut = np.searchsorted(r, np.arange(len(rows) + 1))
        for k, row in enumerate(rows.tolist()):
            if cut[k + 1] > cut[k]:
                found[row].append(h[cut[k] : cut[k + 1]])
    out = []
    for parts in found:
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        out.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return out


def digest(h: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, a row of packed bits each."""
    filters = -(-len(h) // PER_FILTER)
    bits = np.zeros((filters, BITS), bool)
    for k in range(HASHES):
        bits[np.arange(len(h)) // PER_FILTER, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of the smaller digest of the best bit overlap beyond chance, weighted by their bits."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    a, b = sorted((a, b), key=lambda x: (len(x), int(np.bitwise_count(x).sum())))
    nb = np.bitwise_count(b).sum(axis=1).astype(float)
    total = weight = 0.0
    for x in a:
        nx = float(np.bitwise_count(x).sum())
        shared = np.bitwise_count(b & x).sum(axis=1)
        chance = nx * nb / BITS
        most = np.minimum(nx, nb)
        total += nx * float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        weight += nx
    return total / weight


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def in_order(docs: DataFrame, size: int) -> DataFrame:
    """(part, tail, d, h, doc_id, text): parts of the order by descending doc_id; ``tail`` marks the row after a part's last.

    ``size``: bytes of all texts. Parts are cut by ids alone. The highest id of each part also goes to the part before it, and the highest of all to
    the last part, so that each row finds the next one in its own part.
    """
    rows = docs.select(F.coalesce(whole_id(docs), F.lit(NULL_ID)).alias("d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "doc_id", "text")
    room = min(PART_BYTES, max(LEAST_PART, size // (PARTS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)))
    spread = materialise(rows.select("d").distinct().repartitionByRange(max(1, -(-size // room)), F.col("d").desc()).withColumn("p", F.spark_partition_id()))
    heads = np.array(sorted((r[0] for r in spread.groupBy("p").agg(F.max("d")).select("max(d)").collect()), reverse=True), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(heads)

    def place(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        heads = shared.value
        d = batch.column("d").to_numpy()
        # Heads descend: a row belongs to the last part whose head is not below its id.
        part = len(heads) - 1 - np.searchsorted(heads[::-1], d, "left")
        out = [(part, np.zeros(len(d), bool), None)]
        head = np.flatnonzero(heads[part] == d)
        if len(head):
            out.append(((part[head] - 1) % len(heads), np.ones(len(head), bool), pa.array(head)))
        names = ["part", "tail", *batch.schema.names]
        return [pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(t), *(batch if take is None else batch.take(take)).columns], names=names) for p, t, take in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from place(batch)

    types = dict(docs.dtypes)
    placed = rows.mapInArrow(run, f"part int, tail boolean, d long, h long, doc_id {types['doc_id']}, text string")
    return placed.repartitionById(max(1, len(heads)), F.col("part")).sortWithinPartitions("part", "tail", F.col("d").desc(), F.col("h").desc())


@tidied
def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: digests of its text and of its edited text, and likenesses to that and to the next document."""
    counts, size = entropy_counts(docs)
    rank = rarity_ranks(counts)
    id_type = dict(docs.dtypes)["doc_id"]

    def digests(texts: list[str]) -> list[np.ndarray]:
        data, starts = utf8(pa.array(texts, pa.large_string()))
        return [digest(h) for h in features(data, starts, rank)]

    def work(rows: list[tuple]) -> dict:
        """Rows (part, tail, doc_id, text), each followed by the next; the last one only follows."""
        at = [i for i, r in enumerate(rows[:-1]) if not r[1]]
        pairs = [(rows[i], rows[i + 1]) for i in at]
        own = [r[3] for r, _ in pairs]
        edited = [t[: len(t) - len(t) // 3] + f[3][: len(t) // 3] for t, (_, f) in zip(own, pairs, strict=True)]
        done = digests([r[3] for r in rows] + edited)
        a, f, e = [done[i] for i in at], [done[i + 1] for i in at], done[len(rows) :]
        columns = {
            "doc_id": [r[2] for r, _ in pairs],
            "n_chars": pa.array([len(t) for t in own], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(map(text_of, a), pa.string()),
            "edited_fingerprint": pa.array(map(text_of, e), pa.string()),
            "near_edited": pa.array(map(likeness, a, e), pa.float64()),
            "near_next": pa.array(map(likeness, a, f), pa.float64()),
        }
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        schema = None
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            rows = list(zip(batch.column("part").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True))
            rows, s = waiting + rows, 0
            while s < len(rows) - 1:
                e, chars = s + 1, len(rows[s][3])
                while e < len(rows) - 1 and e - s < WORK_ROWS and chars + len(rows[e][3]) <= WORK_CHARS:
                    chars += len(rows[e][3])
                    e += 1
                columns = work(rows[s : e + 1])
                columns["doc_id"] = pa.array(columns["doc_id"], schema)
                yield pa.RecordBatch.from_pydict(columns)
                s = e
            waiting = rows[-1:]

    out = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, size).select("part", "tail", "doc_id", "text").mapInArrow(run, out)
