"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words. Lines of equal words form one class, told by a 128-bit hash of its words; all
but the first of a class go, and only the first takes part in the join. Tokens are ordered by rarity (counts over all
documents, in hashed cells), and a line is listed under its first n - ceil(0.8 n) + 1 of them: two lines with Jaccard
similarity 0.8 or more share a listed token. Under each token, lines in document order look back for the nearest earlier
line that passes the length filter, the positional filter and a parity bitmap, which bounds the symmetric difference;
none of them drops a match. Candidates are verified on the texts of the lines. A line goes if any earlier line matches
it. Looks that failed are repeated by all earlier lines, so that the result is exact. Lines of one to three distinct
words match only lines of the same words, which the classes tell.

Lines and list entries travel packed, a row for each bucket of hashes that a task has something for. A bucket holds
about WORDS_IN_BUCKET words at any size of input. A token listed by more than HOT lines is dealt over parts, where each
line looks back in its own part only; those that find nothing there ask in all parts.

Earlier means a smaller doc_id, then a smaller line number; rows without doc_id come before all others, each by itself and
in any order. ``min_tokens`` is a floor that a caller may
set: lines of fewer distinct words stay. By default no line with words is left out. Null texts stay null; empty lines
and texts stay. Rows that repeat a doc_id are one document in this order: what is removed from one is removed from
another where the line is the same, and they do not remove each other's lines of the same number. Very long texts are
read in buffers of lines; only the lines that go travel back to them. An empty table gives no rows. Other columns are
carried along under any name, but for ``_lines``, which is made anew; ``n_chars`` is counted anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import BUFFER, arrow_map, batch_bytes, fresh_name, lean, materialise, quoted, mix64, row_groups, strings, tidied, utf8, word_hashes, whole_id, with_own_ids

PERCENT = 80
#: Sets of fewer words match equal sets only, at this similarity; a set of four also matches one of five.
SMALL = 4
#: Sets of up to so many words are hashed by all 64 bits of their words, larger ones by HASH_BITS of each.
FEW = 8
CELLS, PIECES = 1 << 20, 64
#: A token is a grade of one byte and so many bits of a hash of the word.
HASH_BITS = 43
#: Words of the corpus for each bucket of lines or list entries, and the most partitions that buckets are dealt over.
WORDS_IN_BUCKET, MOST_PARTITIONS = 2_000_000, 20_000
#: List entries that a task holds before it hands them out, and lines in a packed row.
FLUSH, PACK = 1 << 18, 1 << 13
#: Bytes of packed rows that travel to a task's function at once.
BATCH_BYTES = 8 << 20
#: A token with more list entries is dealt over parts of about half as many; a bucket that holds a token less often than OFTEN doesn't count it.
HOT, OFTEN = 1_000_000, 4
#: Bits of a word's hash that tell cheaply whether it may be one of a few tokens.
TOKEN_BITS = 24
#: Bits of the filter over lines: so many for each, between two sizes; a full one only lets more lines through to a join.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Rows that the driver sets bits for by itself, 16 bytes each; of more, tasks do.
FEW_ROWS = 1 << 17
#: Unsure candidates that a line gives out under one token.
DEPTH = 16
LOOK_ROWS = 1 << 16
#: Distance between the null doc_id and others.
NULL_ID = -(1 << 63)

_LINE = np.dtype([("a", "<u8"), ("b", "<u8"), ("d", "<i8"), ("at", "<i8"), ("low", "<u8"), ("high", "<u8"), ("mark", "<u4"), ("size", "<u4")])
_GONE = np.dtype([("d", "<i8"), ("l", "<i8"), ("mark", "<i8")])
_ENTRY = np.dtype([("group", "<u8"), ("d", "<i8"), ("at", "<i8"), ("low", "<u8"), ("high", "<u8")])
_OFTEN = np.dtype([("token", "<i8"), ("n", "<i8")])
LINES, TOLD, REMOVED = 0, 1, 2
PACKED = "kind int, bucket int, data binary, tokens binary"
_K = np.uint64(0x9FB21C651E98DF25)


def packed_rows(rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.RecordBatch:
    kind, bucket, data, tokens = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary()), pa.array(tokens, pa.binary())], names=["kind", "bucket", "data", "tokens"])


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(whole_id(docs), F.lit(NULL_ID)).alias("d"), "text")


def token_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences over all documents by cell of the token's hash. Tasks give whole arrays in pieces, which are summed."""
    size = CELLS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cells, held = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            data, starts = utf8(batch.column(0))
            for i, j in row_groups(starts, BUFFER):
                h, _, _, _ = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                cells.append((h >> np.uint64(44)).astype(np.int64))
                held += len(h)
                if held > CELLS:
                    total += np.bincount(np.concatenate(cells), minlength=CELLS)
                    cells, held = [], 0
        if cells:
            total += np.bincount(np.concatenate(cells), minlength=CELLS)
        yield piece_rows({p: x for p, x in enumerate(total.reshape(PIECES, size)) if x.any()})

    return put_together(docs.select("text").mapInArrow(lean(count), PIECE_ROWS), np.add, np.int64, size)


PIECE_ROWS = "piece int, task int, data binary"
#: Tasks whose pieces one task puts together at first; what these give is put together by piece.
FAN = 64


def piece_rows(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Pieces of a task's array, under the number of its group of tasks."""
    group = TaskContext.get().partitionId() // FAN
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array([group] * len(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["piece", "task", "data"])


def put_together(rows: DataFrame, join: np.ufunc, kind: type, size: int) -> np.ndarray:
    """The array of all tasks from the pieces (piece, task, data) of each, joined by groups of tasks, then by piece.

    A task holds one array for each piece that it joins, however many tasks gave one; the driver gets each piece once.
    """

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for p, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x, kind)
                found[p, t] = join(found[p, t], x) if (p, t) in found else x
        if found:
            columns = [pa.array([p for p, _ in found], pa.int32()), pa.array([0] * len(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "task", "data"])

    for _ in range(2):
        rows = rows.repartition("piece", "task").mapInArrow(unite, PIECE_ROWS)
    out = np.zeros((PIECES, size), kind)
    # All at once: an iterator over partitions would run a job for each of them.
    for row in rows.collect():
        out[row["piece"]] = join(out[row["piece"]], np.frombuffer(row["data"], kind))
    return out.ravel()


def graded(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte that keeps their order: exact to 63, then by ninths of a doubling."""
    big = np.maximum(counts, 64) / 64
    return np.where(counts < 64, counts, np.minimum(255, 64 + 6 * np.log2(big))).astype(np.uint8)


def line_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of lines, the row of each and its number in the row."""
    ends = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([starts[:-1][np.diff(starts) > 0], ends[ends < len(data)]]))
    row = np.searchsorted(starts, bounds, "right") - 1
    first = np.searchsorted(bounds, starts[row])
    # A line break that ends a row starts no line there, but a later break in the same row does.
    return np.append(bounds, len(data)), row, np.arange(len(bounds)) - first


def distinct_tokens(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each line in ascending order, each once. ``line`` ascends."""
    low = np.uint64(8 + HASH_BITS)
    number = np.cumsum(np.r_[False, line[1:] != line[:-1]]) if len(line) else line
    if len(line) and number[-1] < 1 << (64 - 8 - HASH_BITS):
        both = np.sort((number.astype(np.uint64) << low) | key)
        both = both[np.r_[True, both[1:] != both[:-1]]]
        return both & ((np.uint64(1) << low) - np.uint64(1)), line[np.r_[True, line[1:] != line[:-1]]][(both >> low).astype(np.int64)]
    order = np.lexsort((key, line))
    key, line = key[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    return key[new], line[new]


def set_hashes(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(mix64(key), first), np.bitwise_xor.reduceat(mix64(key * _K), first)


def lines_of(part: np.ndarray, starts: np.ndarray, ids: np.ndarray, grade: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a buffer of texts that have ``min_tokens`` distinct words, and their listed tokens end to end."""
    bounds, row, number = line_starts(part, starts)
    h, line, _, _ = word_hashes(part, bounds)
    if not len(h):
        return np.zeros(0, _LINE), np.zeros(0, np.uint64)
    key = (grade[(h >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    key, of = distinct_tokens(key, line)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[first, len(key)])
    of = of[first]
    a, b = set_hashes(key, first)
    few = n <= FEW
    if few.any():
        some = np.zeros(len(bounds), bool)
        some[of[few]] = True
        hh, ll = h[some[line]], line[some[line]]
        order = np.lexsort((hh, ll))
        hh, ll = hh[order], ll[order]
        new = np.r_[True, (hh[1:] != hh[:-1]) | (ll[1:] != ll[:-1])]
        hh, ll = hh[new], ll[new]
        a[few], b[few] = set_hashes(hh, np.flatnonzero(np.r_[True, ll[1:] != ll[:-1]]))
    bit, upper = np.uint64(1) << (key & np.uint64(63)), (key & np.uint64(64)) > 0
    low, high = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), first) for side in (~upper, upper))
    kept = np.flatnonzero(n >= max(min_tokens, 1))
    of, n = of[kept], n[kept]
    out = np.empty(len(kept), _LINE)
    out["a"], out["b"], out["low"], out["high"], out["d"] = a[kept], b[kept], low[kept], high[kept], ids[row[of]]
    out["at"] = (number[of] << 32) | (np.minimum(n, 65535) << 16)
    out["size"] = size = np.where(n >= SMALL, n - (n * PERCENT + 99) // 100 + 1, 0)
    whole = memoryview(np.ascontiguousarray(part))
    stop = bounds[of + 1] - (part[bounds[of + 1] - 1] == 10)
    out["mark"] = [zlib.crc32(whole[s:e]) for s, e in zip(bounds[of].tolist(), stop.tolist(), strict=True)]
    return out, key[np.repeat(first[kept], size) + counted(size)]


def counted(size: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the sizes, end to end."""
    total = np.cumsum(size, dtype=np.int64)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)


def taken(lines: np.ndarray, tokens: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines in an order (or some of them) with their tokens."""
    size = lines["size"].astype(np.int64)
    start = np.cumsum(size) - size
    return lines[order], tokens[np.repeat(start[order], size[order]) + counted(size[order])]


def first_of_classes(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line of each class, in order of hash, and the others that are not the same place."""
    order = np.argsort(lines["a"])
    a = lines["a"][order]
    same = a[1:] == a[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    some = order[tied]
    order[tied] = some[np.lexsort((lines["at"][some], lines["d"][some], lines["b"][some], lines["a"][some]))]
    a, b, d, l = (lines["a"][order], lines["b"][order], lines["d"][order], lines["at"][order] >> 32)
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else order
    return order[new], order[~new & ((d != d[first]) | (l != l[first]))]


def removed_rows(lines: np.ndarray, bucket: int) -> tuple[int, int, bytes, None]:
    out = np.empty(len(lines), _GONE)
    out["d"], out["l"], out["mark"] = lines["d"], lines["at"] >> 32, lines["mark"]
    return REMOVED, bucket, out.tobytes(), None


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together, in as many partitions as there are buckets, up to a bound."""
    parts = min(buckets, MOST_PARTITIONS)
    return rows.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Each bucket with its rows of (kind, data, tokens), from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for kind, bucket, data, tokens in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "data", "tokens")), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append((kind, data, tokens))
    if held:
        yield now, held


def classes(docs: DataFrame, counts: np.ndarray, min_tokens: int, buckets: int) -> DataFrame:
    """Packed rows: the first lines of classes with their tokens, tokens that a bucket lists often, and lines that go as others of a class.

    A task keeps the first of each class that it sees, so that a class of any size sends a line from each task at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(graded(counts))

    def packs(lines: np.ndarray, tokens: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lines and tokens by bucket, which ascends."""
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        cut = np.unique(np.r_[cut, np.arange(0, len(of), PACK), len(of)]).astype(np.int64)
        ends = np.r_[0, np.cumsum(lines["size"], dtype=np.int64)]
        for c in range(0, len(cut) - 1, 64):
            yield packed_rows([(LINES, int(of[s]), lines[s:e].tobytes(), tokens[ends[s] : ends[e]].tobytes()) for s, e in zip(cut[c : c + 64].tolist(), cut[c + 1 : c + 65].tolist(), strict=False)])

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lines, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        first, others = first_of_classes(lines)
        # The upper half of the hash tells the bucket, so that buckets ascend with it.
        of = (lines["a"][first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        yield from packs(*taken(lines, tokens, first), of)
        if len(others):
            yield packed_rows([removed_rows(lines[others], int(lines["a"][others[0]] % np.uint64(buckets)))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            ids = batch.column("d").to_numpy()
            for i, j in row_groups(starts, BUFFER):
                found = lines_of(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], ids[i:j], shared.value, min_tokens)
                held.append(found)
                size += len(found[0]) + len(found[1])
                if size >= FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches):
            yield packed_rows([(kind, bucket, data, tokens) for kind, data, tokens in rows if kind != LINES])
            blobs = [(data, tokens) for kind, data, tokens in rows if kind == LINES]
            if not blobs:
                continue
            lines, tokens = np.frombuffer(b"".join(x for x, _ in blobs), _LINE), np.frombuffer(b"".join(x for _, x in blobs), np.uint64)
            first, others = first_of_classes(lines)
            if len(others):
                yield packed_rows([removed_rows(lines[others], bucket)])
            lines, tokens = taken(lines, tokens, first)
            yield from packs(lines, tokens, np.full(len(lines), bucket))
            value, n = np.unique(tokens, return_counts=True)
            often = np.empty((n >= OFTEN).sum(), _OFTEN)
            often["token"], often["n"] = value[n >= OFTEN].view(np.int64), n[n >= OFTEN]
            if len(often):
                yield packed_rows([(TOLD, bucket, often.tobytes(), None)])

    return dealt(ids_and_texts(docs).mapInArrow(lean(read), PACKED), buckets).mapInArrow(lean(merge), PACKED)


def unpacked(rows: DataFrame, kind: int, dtype: np.dtype) -> DataFrame:
    """Numbers of packed rows of a kind, a row each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in dtype.names], names=list(dtype.names))

    return arrow_map(rows.where(F.col("kind") == kind).select("data"), run, ", ".join(f"{c} long" for c in dtype.names))


def hot_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of more than HOT list entries, ascending, and how many parts each is dealt over: fewer than one in HOT entries."""
    rows = unpacked(found, TOLD, _OFTEN).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).collect()
    rows = sorted((r["token"], -(-2 * r["n"] // HOT)) for r in rows)
    return np.array([t for t, _ in rows], np.uint64), np.array([n for _, n in rows], np.uint64)


def parts_of(token: np.ndarray, d: np.ndarray, at: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are of hot tokens, and the group of each of those: its token's part that the line is dealt to."""
    tokens, parts = hot
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
    some = np.flatnonzero(tokens[k] == token)
    part = line_hash(d[some], at[some] >> 32) % parts[k[some]]
    return some, part_group(token[some], part)


def part_group(token: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Groups of parts are told from tokens by their highest bit."""
    return mix64(token * _K + part) | np.uint64(1 << 63)


def line_hash(d: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(d.view(np.uint64) ^ mix64(line.astype(np.uint64) + np.uint64(7)))


def entries_of(data: bytes, tokens: bytes) -> np.ndarray:
    """List entries of packed lines: token (as group), place and bitmap."""
    lines, tokens = np.frombuffer(data, _LINE), np.frombuffer(tokens, np.uint64)
    of = np.repeat(np.arange(len(lines)), lines["size"])
    out = np.empty(len(tokens), _ENTRY)
    out["group"], out["d"], out["low"], out["high"] = tokens, lines["d"][of], lines["low"][of], lines["high"][of]
    out["at"] = lines["at"][of] | np.minimum(counted(lines["size"].astype(np.int64)), 65535)
    return out


def listed(found: DataFrame, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Packed list entries by bucket of their groups."""
    shared = found.sparkSession.sparkContext.broadcast(hot)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        held.clear()
        some, group = parts_of(e["group"], e["d"], e["at"], shared.value)
        e["group"][some] = group
        bucket = bucket_of(e["group"], buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
        e, bucket = e[order], bucket[order]
        cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(e)]
        for c in range(0, len(cut) - 1, 64):
            yield packed_rows([(LINES, int(bucket[s]), e[s:t].tobytes(), None) for s, t in zip(cut[c : c + 64].tolist(), cut[c + 1 : c + 65].tolist(), strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for data, tokens in zip(batch.column("data").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                held.append(entries_of(data, tokens))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from send(held)
                    size = 0
        if size:
            yield from send(held)

    return dealt(found.where(F.col("kind") == LINES).select("data", "tokens").mapInArrow(lean(run), PACKED), buckets)


def filtered(x: np.ndarray, y: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the row pairs (x[i], y[i]) pass the length, positional and bitmap filters; bits that differ; the most that may."""
    ax, ay = at[x], at[y]
    nx, ny = (ax >> 16) & 65535, (ay >> 16) & 65535
    ok = np.flatnonzero(np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * PERCENT)
    ax, ay, nx, ny = ax[ok], ay[ok], nx[ok], ny[ok]
    ix, iy = ax & 65535, ay & 65535
    need = -(-(nx + ny) * PERCENT // (100 + PERCENT))
    long = np.maximum(nx, ny) == 65535
    pass_ = (np.minimum(nx - ix, ny - iy) + np.minimum(ix, iy) >= need) | long
    ok, need, total, long = ok[pass_], need[pass_], (nx + ny)[pass_], long[pass_]
    x, y, most = x[ok], y[ok], total - 2 * need
    differ = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y])
    pass_ = (differ <= most) | long
    return ok[pass_], np.where(long, 65535, differ)[pass_], most[pass_]


def shared_groups(e: np.ndarray) -> np.ndarray:
    """Entries of groups of two or more, in order of group, d and place."""
    n = len(e)
    bits = np.uint64(max(1, int(n).bit_length()))
    # One sort of numbers: the group's hash above the row's number. Groups whose cut hashes are equal are told apart below.
    packed = np.sort(((mix64(e["group"]) >> bits) << bits) | np.arange(n, dtype=np.uint64))
    h = packed >> bits
    same = h[1:] == h[:-1]
    some = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[np.r_[False, same] | np.r_[same, False]]
    e = e[some]
    return e[np.lexsort((e["at"], e["d"], e["group"]))]


def begins(group: np.ndarray) -> np.ndarray:
    """Where the group of each row begins."""
    begin = np.zeros(len(group), np.int64)
    change = np.flatnonzero(group[1:] != group[:-1]) + 1
    begin[change] = change
    return np.maximum.accumulate(begin)


def look_back(entries: DataFrame) -> DataFrame:
    """(xd, xl, yd, yl, more): lines and earlier lines under the same token that may match.

    Each line looks one line further back at a time, to the first that differs by no more than half of what a match
    may. That one is given out, and the first DEPTH that may match at all; ``more`` is 1 where others may lie beyond.
    A line under a part of a hot token that has no sure one there is given out without another.
    """

    def pairs(e: np.ndarray) -> pa.RecordBatch:
        group, d, at, low, high = (np.ascontiguousarray(e[c]) for c in _ENTRY.names)
        begin, active, had = begins(group), np.arange(len(group)), np.zeros(len(group), np.int64)
        out, certain = [np.zeros((3, 0), np.int64)], np.zeros(len(group), bool)
        lag = 1
        while len(active := active[active - lag >= begin[active]]):
            hit, differ, most = filtered(active, active - lag, at, low, high)
            x = active[hit]
            apart = (d[x] != d[x - lag]) | (at[x] >> 32 != at[x - lag] >> 32)
            x, hit, sure = x[apart], hit[apart], (2 * differ <= most)[apart]
            had[x] += 1
            out.append(np.stack([x, x - lag, sure | (had[x] == DEPTH)])[:, sure | (had[x] <= DEPTH)])
            stays = np.ones(len(active), bool)
            stays[hit[sure]] = False
            certain[x[sure]] = True
            active = active[stays]
            lag += 1
        x, y, more = np.concatenate(out, axis=1)
        alone = np.flatnonzero((group >> np.uint64(63)).astype(bool) & ~certain)
        none = pa.nulls(len(alone), pa.int64())
        own = [pa.array(d[x]), pa.array(at[x] >> 32), pa.array(d[y]), pa.array(at[y] >> 32), pa.array(more)]
        rest = [pa.array(d[alone]), pa.array(at[alone] >> 32), none, none, pa.array(np.ones(len(alone), np.int64))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(own, rest, strict=True)], names=["xd", "xl", "yd", "yl", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            e = np.frombuffer(b"".join(data for _, data, _ in rows), _ENTRY)
            # Parts of hot tokens are given out even if a line is alone in one.
            single = e[(e["group"] >> np.uint64(63)).astype(bool)]
            rest = e[~(e["group"] >> np.uint64(63)).astype(bool)]
            yield pairs(np.concatenate([single[np.lexsort((single["at"], single["d"], single["group"]))], shared_groups(rest)]))

    return entries.mapInArrow(lean(run), "xd long, xl long, yd long, yl long, more long")


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups, from rows that come sorted by their first column; single rows are left out.

    Rows of a group are put in order of d and at. A group is held in memory, which HOT bounds.
    """

    def ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
        g = columns[0]
        same = g[1:] == g[:-1]
        some = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        columns = [c[some] for c in columns]
        order = np.lexsort((columns[names.index("at")], columns[names.index("d")], columns[0]))
        return [c[order] for c in columns]

    waiting: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        count += batch.num_rows
        last = waiting[-1][0][-1]
        if count >= LOOK_ROWS and waiting[0][0][0] != last:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            cut = int(np.searchsorted(columns[0], last, "left"))
            yield ordered([c[:cut] for c in columns])
            waiting = [[c[cut:] for c in columns]]
            count = len(waiting[0][0])
    if waiting:
        yield ordered([np.concatenate(x) for x in zip(*waiting, strict=True)])


def near_askers(rows: DataFrame) -> DataFrame:
    """(group, d, at, low, high, asks): asking lines and earlier lines under the same token that may match them."""
    names = ("group", "d", "at", "low", "high", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches, names):
            group, _, at, low, high, asks = columns
            low, high = low.view(np.uint64), high.view(np.uint64)
            begin, near = begins(group), np.zeros(len(group), bool)
            active, lag = np.flatnonzero(asks), 1
            while len(active := active[active - lag >= begin[active]]):
                x = active[filtered(active, active - lag, at, low, high)[0]]
                near[x] = near[x - lag] = True
                lag += 1
            yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in columns], names=list(names))

    return rows.mapInArrow(run, "group long, d long, at long, low long, high long, asks boolean").distinct()


def look_through(rows: DataFrame) -> DataFrame:
    """(d, l): asking lines that match any earlier line under the same token, checked on the lines themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, d, at, low, high, line, asks in whole_groups(batches, ("group", "d", "at", "low", "high", "line", "asks")):
            low, high = low.view(np.uint64), high.view(np.uint64)
            begin, out = begins(group), []
            for x in np.flatnonzero(asks).tolist():
                earlier = np.arange(begin[x], x)
                hit, differ, _ = filtered(np.full(len(earlier), x), earlier, at, low, high)
                words = set(line[x].encode().split())
                for y in earlier[hit[np.argsort(differ, kind="stable")]].tolist():
                    other = set(line[y].encode().split())
                    if (d[x], at[x] >> 32) != (d[y], at[y] >> 32) and 100 * len(words & other) >= PERCENT * len(words | other):
                        out.append((d[x], at[x] >> 32))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["d", "l"])

    return rows.mapInArrow(run, "d long, l long").distinct()


def sorted_groups(rows: DataFrame) -> DataFrame:
    """One sort column of a number: Spark sorts it by radix."""
    return rows.repartition("group").sortWithinPartitions("group")


def entry_rows(found: DataFrame, keep) -> DataFrame:
    """(token, d, at, low, high) of the list entries that ``keep`` picks from arrays of token, d and line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, tokens in zip(batch.column("data").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                e = entries_of(data, tokens)
                e = e[keep(e["group"], e["d"], e["at"] >> 32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c]).view(np.int64)) for c in _ENTRY.names], names=["token", "d", "at", "low", "high"])

    return found.where(F.col("kind") == LINES).select("data", "tokens").mapInArrow(run, "token long, d long, at long, low long, high long")


def grouped(rows: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows of (token, d, at, low, high, asks) with their group. Under a hot token a line that asks goes to all parts, another to its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, parts = hot
        for batch in batches:
            if not batch.num_rows:
                continue
            token, d, at, low, high = (batch.column(c).to_numpy() for c in ("token", "d", "at", "low", "high"))
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            row, group = np.arange(len(token)), token.view(np.uint64).copy()
            some, own = parts_of(group, d, at, hot)
            if len(some):
                group[some] = own
                times = np.ones(len(token), np.int64)
                ask = some[asks[some]]
                times[ask] = parts[np.searchsorted(tokens, token[ask].view(np.uint64))].astype(np.int64)
                row = np.repeat(row, times)
                part, group = counted(times).astype(np.uint64), group[row]
                all_ = np.flatnonzero(times[row] > 1)
                group[all_] = part_group(token[row[all_]].view(np.uint64), part[all_])
            yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), *(pa.array(c[row]) for c in (d, at, low, high, asks))], names=["group", "d", "at", "low", "high", "asks"])

    return sorted_groups(rows.select("token", "d", "at", "low", "high", "asks").mapInArrow(run, "group long, d long, at long, low long, high long, asks boolean"))


def places_of(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def filter_over(lines: DataFrame, d: str = "d", line: str = "l") -> np.ndarray:
    """A Bloom filter over places of lines, of a size by their number."""
    n = lines.count()
    size = min(max(LEAST_BITS, 1 << int(BITS_A_LINE * n).bit_length()), MOST_BITS)
    return _bits_of(lines.select(d, line), n, lambda batch: places_of(line_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()), size), size)


def passes(bits: np.ndarray, d: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which lines may be among those of a filter of packed bits."""
    p, q = places_of(line_hash(d, line), 8 * len(bits))
    of = lambda x: (bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & np.uint8(1)
    return (of(p) & of(q)).astype(bool)


def token_cells(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(HASH_BITS - TOKEN_BITS) & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)


def _bits_of(rows: DataFrame, n: int, places, size: int) -> np.ndarray:
    """Packed bits set at the places of all ``n`` rows. Every task sets its own, and pieces are put together in tasks; the driver does so with a few rows."""
    piece = size // 8 // PIECES

    def set_bits(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        bits = None
        for batch in batches:
            if batch.num_rows:
                bits = np.zeros(size // 8, np.uint8) if bits is None else bits
                for p in places(batch):
                    np.bitwise_or.at(bits, p >> 3, np.uint8(128) >> (p & 7).astype(np.uint8))
        return bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = set_bits(batches)
        if bits is not None:
            yield piece_rows({p: x for p, x in enumerate(bits.reshape(PIECES, piece)) if x.any()})

    if n <= FEW_ROWS:
        bits = set_bits(rows.toArrow().to_batches())
        return np.zeros(size // 8, np.uint8) if bits is None else bits
    return put_together(rows.mapInArrow(lean(build), PIECE_ROWS), np.bitwise_or, np.uint8, piece)


def wanted_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(d, l, line) for the wanted (d, l), which may repeat: a filter drops most others before they are shuffled, a join the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_over(lines))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            if not len(data):
                continue
            bounds, row, number = line_starts(data, starts)
            d = batch.column("d").to_numpy()[row]
            some = np.flatnonzero(passes(bits, d, number))
            stop = bounds[some + 1] - (data[bounds[some + 1] - 1] == 10)
            whole = data.tobytes() if len(some) else b""
            text = [whole[s:e].decode() for s, e in zip(bounds[some].tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(number[some]), pa.array(text, pa.string())], names=["d", "l", "line"])

    found = ids_and_texts(docs).mapInArrow(lean(split), "d long, l long, line string")
    return found.join(lines, ["d", "l"], "left_semi").distinct()


def matches(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(d, l, mark): later lines of the pairs that hold on the texts; ``mark`` is a checksum of the line."""
    side = lambda s: texts.select(F.col("d").alias(s + "d"), F.col("l").alias(s + "l"), F.col("line").alias(s))

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok, mark = [], []
        for x, y in zip(strings(batch.column("x")), strings(batch.column("y")), strict=True):
            x = x.encode()
            mark.append(zlib.crc32(x))
            a, b = set(x.split()), set(y.encode().split())
            ok.append(100 * len(a & b) >= PERCENT * len(a | b))
        return pa.RecordBatch.from_arrays([batch.column("xd"), batch.column("xl"), pa.array(mark, pa.int64())], names=["d", "l", "mark"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(side("x"), ["xd", "xl"]).join(side("y"), ["yd", "yl"]).select("xd", "xl", "x", "y")
    return arrow_map(full, check, "d long, l long, mark long")


def pairs_of(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs whose later line is among ``lines`` (d, l)."""
    return pairs.where("yd IS NOT NULL").join(lines.select(F.col("d").alias("xd"), F.col("l").alias("xl")), ["xd", "xl"], "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    """(d, l) of both lines of the pairs, as often as they are in one."""
    return pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).union(pairs.select("yd", "yl"))


def repeated_lines(docs: DataFrame, min_tokens: int = 1) -> DataFrame:
    """(d, l, mark) of the lines that go; some may come twice."""
    counts = token_counts(docs)
    buckets = int(-(-counts.sum() // WORDS_IN_BUCKET)) or 1
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        found = materialise(classes(docs, counts, min_tokens, buckets))
    gone = unpacked(found, REMOVED, _GONE)
    hot = hot_tokens(found)
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        pairs = materialise(look_back(listed(found, hot, buckets)))
    # Any sure pair of a line first; all its pairs only if that fails or if it has no sure one.
    sure = lambda c: F.first(F.when(F.col("more") == 1, F.col(c)), ignorenulls=True).alias(c)
    best = materialise(pairs.groupBy("xd", "xl").agg(sure("yd"), sure("yl"), F.max("more").alias("more")))
    line = [F.col("xd").alias("d"), F.col("xl").alias("l")]
    first = best.where("yd IS NOT NULL").drop("more")
    held = materialise(matches(first, wanted_lines(docs, ends(first))))
    gone = gone.unionByName(held)
    failed = materialise(best.select(*line, "more").join(held, ["d", "l"], "left_anti"))
    if failed.limit(1).count():
        left = materialise(pairs_of(pairs, failed).select("xd", "xl", "yd", "yl").distinct())
        more = materialise(matches(left, wanted_lines(docs, ends(left))).distinct())
        gone = gone.unionByName(more)
        failed = materialise(failed.where("more = 1").drop("more").join(more, ["d", "l"], "left_anti"))
    if failed.limit(1).count():
        gone = gone.unionByName(asked(docs, found, failed, hot))
    return gone


def asked(docs: DataFrame, found: DataFrame, failed: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(d, l, mark): lines of ``failed`` (d, l) that match any earlier line.

    Their looks ended at lines that didn't match, or at the end of a part, with others beyond: they look through
    everything under their tokens. The lists alone first tell what may match, and only those lines are brought.
    """
    context = docs.sparkSession.sparkContext
    own = context.broadcast(filter_over(failed))
    asking = entry_rows(found, lambda token, d, line: passes(own.value, d, line)).withColumn("l", F.shiftright("at", 32)).join(failed, ["d", "l"], "left_semi")
    tokens = materialise(asking.select("token").distinct())
    cells = context.broadcast(_bits_of(tokens, tokens.count(), lambda batch: [token_cells(batch.column(0).to_numpy().view(np.uint64))], 1 << TOKEN_BITS))

    def wanted(token: np.ndarray, d: np.ndarray, line: np.ndarray) -> np.ndarray:
        cell = token_cells(token)
        return ((cells.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & np.uint8(1)).astype(bool)

    some = entry_rows(found, wanted).join(tokens, "token", "left_semi").withColumn("l", F.shiftright("at", 32))
    some = some.join(failed.withColumn("asks", F.lit(True)), ["d", "l"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))).drop("l")
    near = materialise(near_askers(grouped(some, hot)).withColumn("l", F.shiftright("at", 32)))
    lines = materialise(wanted_lines(docs, near.select("d", "l")))
    last = look_through(sorted_groups(near.join(lines, ["d", "l"]).drop("l"))).join(lines, ["d", "l"])
    return last.select("d", "l", F.crc32(F.col("line").cast("binary")).alias("mark"))


@tidied
def without_repeated_lines(docs: DataFrame, min_tokens: int = 1) -> DataFrame:
    """``docs`` with the lines that match earlier ones removed from ``text``; ``_lines`` counts all and removed lines."""
    docs = docs.drop("_lines")
    name, own, columns = fresh_name(docs, "gone"), fresh_name(docs, "own"), docs.columns
    docs = with_own_ids(docs, own, NULL_ID)
    gone = repeated_lines(docs.select(F.col(own).alias("doc_id"), "text"), min_tokens).groupBy("d").agg(F.collect_set(F.struct("l", "mark")).alias(name))
    joined = docs.join(gone, docs[own] == gone["d"], "left").select(*[docs[quoted(c)] for c in columns], name)
    count = pa.struct([("n_lines", pa.int32()), ("n_removed", pa.int32())])

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, marks = batch.column("text"), batch.column(name)
        lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int32()).to_numpy(zero_copy_only=False)
        removed = np.zeros(batch.num_rows, np.int32)
        changed = pc.and_(pc.is_valid(marks), pc.is_valid(text))
        new = []
        for i, t, m in zip(np.flatnonzero(changed.to_numpy(zero_copy_only=False)).tolist(), text.filter(changed).to_pylist(), marks.filter(changed).to_pylist(), strict=True):
            known, own = {}, t.split("\n")
            for x in m:
                known.setdefault(x["l"], set()).add(x["mark"])
            kept = [x for k, x in enumerate(own) if k not in known or zlib.crc32(x.encode()) not in known[k]]
            removed[i] = len(own) - len(kept)
            new.append("\n".join(kept))
        text = pc.replace_with_mask(text, changed, pa.array(new, text.type))
        counts = pa.StructArray.from_arrays([pa.array(lines), pa.array(removed)], fields=list(count))
        made = {"text": text, "n_chars": pc.utf8_length(text).cast(pa.int64())}
        names = [n for n in batch.schema.names if n != name]
        return pa.RecordBatch.from_arrays([*(made.get(n, batch.column(n)) for n in names), counts], names=[*names, "_lines"])

    schema = ", ".join(f"{quoted(c)} {'long' if c == 'n_chars' else 'string' if c == 'text' else t}" for c, t in docs.dtypes if c != own)
    return arrow_map(joined, rebuild, f"{schema}, _lines struct<n_lines:int,n_removed:int>")


ORACLE_SQL = r"""
    WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
         u AS (SELECT doc_id, unnest(range(len(lines))) AS k, unnest(lines) AS line FROM s),
         l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, k) AS i, doc_id, k, line, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM u),
         t AS (SELECT i, len(w) AS n, unnest(w) AS g FROM l),
         f AS (SELECT g, count(*) AS c FROM t GROUP BY g),
         p AS MATERIALIZED (SELECT i, g FROM (SELECT i, n, t.g, row_number() OVER (PARTITION BY i ORDER BY c, t.g) AS r FROM t JOIN f ON f.g = t.g) WHERE r <= n - (n * 80 + 99) // 100 + 1),
         c AS (SELECT DISTINCT a.i AS x, b.i AS y FROM p a JOIN p b ON a.g = b.g AND b.i < a.i),
         o AS (SELECT x, len(a.w) + len(b.w) AS sizes, len(list_intersect(a.w, b.w)) AS shared FROM c JOIN l a ON a.i = x JOIN l b ON b.i = y),
         m AS (SELECT DISTINCT x FROM o WHERE 100 * shared >= 80 * (sizes - shared)),
         r AS (SELECT doc_id, count(*)::INTEGER AS n_lines, count(x)::INTEGER AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (x IS NULL), '') AS text FROM l LEFT JOIN m ON x = i GROUP BY doc_id)
    SELECT d.doc_id, r.text, length(r.text)::BIGINT AS n_chars, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
