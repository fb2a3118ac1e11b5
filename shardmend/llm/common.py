"""What the operators share: table access, text buffers, materialised cuts, distributed ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch, which is held in memory whole; Spark also ends a batch at 64 MB.
BATCH_ROWS = 1024
#: Bytes of text that are worked on at once: arrays of 8 bytes for each of them stay near the processor.
BUFFER = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Rows of whole texts: the session keeps a smaller bound if it has one.
    bound = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(bound, "0")) <= BATCH_ROWS:
        spark.conf.set(bound, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session takes a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


#: Cuts that the running operator has written.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose cuts are deleted when it returns, but for those that its result still reads."""

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        made: list[str] = []
        outer = _MADE.get()
        token = _MADE.set(made)
        try:
            out = f(*args, **kwargs)
        finally:
            _MADE.reset(token)
        read = _folders(out) if made else ""
        for path in made:
            if path.rsplit("/", 1)[1] in read:
                if outer is not None:
                    outer.append(path)
            else:
                _delete(out.sparkSession, path)
        return out

    return run


def _folders(df: DataFrame) -> str:
    """The folders that a plan reads, however many files are in them."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves().iterator(), []
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            out.append(leaf.relation().location().rootPaths().mkString("\n"))
    return "\n".join(out)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors and repeat no work."""
    spark = df.sparkSession
    path = f"{cuts_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cuts_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what this application has materialised; call it when the results that read from it are written."""
    _delete(spark, cuts_folder(spark))


def quoted(name: str) -> str:
    """A column's name as expressions take it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fields(names: Iterable[str]) -> list[Column]:
    """Columns of any names, which they keep."""
    return [F.col(quoted(c)).alias(c) for c in names]


def whole_id(docs: DataFrame) -> Column:
    """doc_id as a 64-bit number, for operators that order or link by it; ids of other kinds are refused."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"doc_id must be a whole number here, not {kind}: number the rows first")
    return docs["doc_id"].cast("long")


def with_own_ids(docs: DataFrame, name: str, base: int) -> DataFrame:
    """``docs`` with a column ``name``: doc_id as a number, and for rows without one a number of their own from ``base`` on.

    Rows without an id are written once, if there are any, so that their numbers hold however often they are read.
    """
    lone = docs.where("doc_id IS NULL")
    if lone.isEmpty():
        return docs.withColumn(name, whole_id(docs))
    numbered = materialise(lone.withColumn(name, F.monotonically_increasing_id() + base))
    return docs.where("doc_id IS NOT NULL").withColumn(name, whole_id(docs)).unionByName(numbered)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Hand memory that Arrow and the C library keep for later back to the system: workers live on idle after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function over batches that gives memory back when it ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches that end at ``size`` bytes for jobs that run inside; for rows of large packed values."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from batch to batch. Columns may have any names; Spark itself takes none with a dot here."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch.rename_columns(names))

    plain = df.toDF(*[f"_{i}" for i in range(len(names))]) if any(c in name for name in names for c in ".`") else df
    return plain.mapInArrow(lean(run), schema)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to ``rows`` for jobs that run inside; for rows of a few numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row starts (one more at the end); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def row_groups(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to ``limit`` bytes, or one longer row."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit keys."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = mix64(np.arange(1, 257, dtype=np.uint64))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return values, space, lower


BYTE_VALUE, IS_SPACE, LOWER = _tables()
_BASE = np.uint64(0xC6A4A7935BD1E995 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64, kept for the longest buffer so far."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.ones(size, np.uint64)
            p[1:] = base
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, is_break: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: 64-bit hash, row, first byte, end. Equal words hash alike wherever they stand.

    ``data`` holds the rows end to end from ``starts[i]`` on; a word never crosses rows.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~is_break[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = starts[:-1][starts[:-1] < n]
    first[row_starts] = inside[row_starts]
    last = np.zeros(n, bool)
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    last[-1] = inside[-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=total[1:])
    h = mix64((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(np.uint64))
    row = np.searchsorted(starts, begin, "right") - 1
    return h, row, begin, end


def shingle_hashes(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of runs of ``k`` words; a row with fewer words gives its whole sequence as one."""
    count = np.bincount(row, minlength=rows)
    n = len(h)
    if not n:
        return h, row
    width = np.minimum(count[row], k)
    start_of = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=start_of[1:])
    place = np.arange(n) - start_of[row]
    ok = place + width <= count[row]
    out = np.zeros(n, np.uint64)
    for i in range(k):
        moved = np.zeros(n, np.uint64)
        moved[: max(n - i, 0)] = h[i:]
        out = np.where(i < width, mix64(out * np.uint64(0x2545F4914F6CDD1D) + moved + np.uint64(i + 1)), out)
    return out[ok], row[ok]


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_key(doc_id: Column, text: Column) -> Column:
    """What a row's draws depend on: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, of 52 bits: any engine can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(df: DataFrame, group: list[str], order: list[Column], shard: Column, name: str = "rank", counted: DataFrame | None = None) -> DataFrame:
    """``df`` with each row's place from 0 within its group, without one task for a group.

    ``shard`` numbers parts of the order: all rows of a lower shard come before those of a higher one. Ranks are taken
    within (group, shard); the sizes of the shards before are added, over a table with one row for each shard. ``counted``
    may name a cheaper table of the same rows to count them in.
    """
    from pyspark.sql import Window as W

    counted = (df if counted is None else counted).withColumn("_shard", shard)
    df = df.withColumn("_shard", shard)
    inner = df.withColumn("_place", F.row_number().over(W.partitionBy(*group, "_shard").orderBy(*order)) - 1)
    sizes = counted.groupBy(*group, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*group).orderBy("_shard")) - F.col("_n")).drop("_n")
    on = [inner[c].eqNullSafe(before[c]) for c in [*group, "_shard"]]
    joined = inner.join(before, on)
    return joined.select(*[inner[c] for c in inner.columns if c not in ("_shard", "_place")], (F.col("_place") + F.col("_before")).cast("long").alias(name))
