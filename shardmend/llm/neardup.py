"""Near-duplicate documents by SetSketch registers.

Each text becomes the set of its word shingles. Of every set, M registers keep floor(1 - log_B(x)) for the smallest of
exponentially distributed hash values x, truncated to [0, Q + 1]; registers of a union are the larger ones, and equal
registers grow likelier with similarity. Equal sets become one class. Bands of registers put classes into buckets, a
pair's similarity is estimated by maximum likelihood from its registers and set sizes, and pairs near the threshold or
above it are verified on the full sets.

No bucket is written out as pairs. First each member meets one or two leaders of its bucket only, best estimate first.
What is then still in different components of one bucket is compared in blocks of registers, all against all, and
verified there; only links leave a block. Links inside a component cannot change the result and are skipped.

Null and empty texts have no shingles and are linked with nothing. A text with fewer words than a shingle is one
shingle; a very long one is sketched in steps of 1,024 shingles and verified on its full set. Ids must be whole numbers; ``near_duplicates`` keeps rows
without doc_id and links them with nothing, ``deduplicated`` gives each a number of its own. Rows that repeat a doc_id with the same text share one decision. An empty table gives no rows.
Other columns may have any names; ``deduplicated`` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import BUFFER, LOWER, arrow_map, fresh_name, materialise, mix64, row_groups, shingle_hashes, tidied, utf8, whole_id, with_own_ids, word_hashes

M, BANDS, ROWS = 256, 42, 6
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Links need 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Estimates this far below the threshold, four standard deviations of M registers, are not verified.
SLACK = 0.1
BLOCK, USUAL = 512, 400.0

_RANDOM = mix64(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_FACTOR = (_RANDOM[:M] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_RANDOM[M:] >> np.uint64(32)).astype(np.uint32)


def registers(smallest: np.ndarray) -> np.ndarray:
    """Registers from the smallest 32-bit hash of each function: uniform, so exponential after -log(1 - u)."""
    x = -np.log1p(-(smallest.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, a, b, regs): size, two hashes of the whole set, registers; regs is null for an empty set."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8(batch.column("text"))
        rows = batch.num_rows
        n, a, b = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        regs: list[bytes | None] = [None] * rows
        for i, j in row_groups(starts, BUFFER):
            h, row, _, _ = word_hashes(LOWER[data[starts[i] : starts[j]]], starts[i : j + 1] - starts[i])
            h, row = shingle_hashes(h, row, j - i, k)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            if not len(h):
                continue
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            ends = np.r_[at[1:], len(h)]
            n[i + row[at]] = ends - at
            a[i + row[at]] = np.add.reduceat(mix64(h), at).view(np.int64)
            b[i + row[at]] = np.bitwise_xor.reduceat(mix64(h * np.uint64(0x9FB21C651E98DF25)), at).view(np.int64)
            short = (h >> np.uint64(32)).astype(np.uint32)
            least = np.empty((len(at), M), np.uint32)
            for r, (s, e) in enumerate(zip(at, ends, strict=True)):
                low = None
                for c in range(s, e, 1024):
                    part = (short[c : min(e, c + 1024), None] * _FACTOR + _SHIFT).min(axis=0)
                    low = part if low is None else np.minimum(low, part)
                least[r] = low
            for r, x in zip(i + row[at], registers(least), strict=True):
                regs[r] = x.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), pa.array(regs, pa.binary())], names=["doc_id", "n", "a", "b", "regs"])

    return arrow_map(docs.select(whole_id(docs).alias("doc_id"), "text"), sketch, "doc_id long, n long, a long, b long, regs binary")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """The bucket of each class in each band, from rows of registers."""
    regs = regs.astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x2545F4914F6CDD1D) + regs[:, r : BANDS * ROWS : ROWS] + np.uint64(1))
    return key.view(np.int64)


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, cid): a row for each band of a class."""

    def bands(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = band_keys(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, M))
        cid = np.repeat(batch.column("cid").to_numpy(), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(cid)], names=["bucket", "cid"])

    return arrow_map(classes.select("cid", "regs"), bands, "bucket long, cid long")


_GRID = np.linspace(0, 1, 201)


def likely_similarity(more: np.ndarray, less: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given how many registers of U are above and below V's, and sizes."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    top = np.minimum(nu, nv) / np.maximum(nu, nv)
    j = _GRID[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = np.maximum(1 - above - below, 1e-12)
    d = (more[:, None], less[:, None])
    score = d[0] * np.log(np.maximum(above, 1e-12)) + d[1] * np.log(np.maximum(below, 1e-12)) + (M - d[0] - d[1]) * np.log(same)
    return j[np.arange(len(j)), score.argmax(axis=1)]


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y, est) of the pairs (x, y) whose estimate passes."""
    a = classes.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("regs").alias("rx"))
    b = classes.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("regs").alias("ry"))
    near = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * PERCENT

    def estimate(batch: pa.RecordBatch) -> pa.RecordBatch:
        rx, ry = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("rx", "ry"))
        est = likely_similarity((rx > ry).sum(axis=1), (rx < ry).sum(axis=1), batch.column("nx").to_numpy(), batch.column("ny").to_numpy())
        ok = pa.array(est >= PERCENT / 100 - SLACK)
        return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(est)], names=["x", "y", "est"]).filter(ok)

    return arrow_map(pairs.join(a, "x").join(b, "y").where(near).select("x", "y", "nx", "ny", "rx", "ry"), estimate, "x long, y long, est double")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(cid, members): all shingles of a text as sorted 64-bit hashes."""

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8(batch.column("text"))
        out = []
        for i, j in row_groups(starts, BUFFER):
            h, row, _, _ = word_hashes(LOWER[data[starts[i] : starts[j]]], starts[i : j + 1] - starts[i])
            h, row = shingle_hashes(h, row, j - i, k)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            out += [np.unique(h[s:e]).tobytes() for s, e in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(out, pa.binary())], names=["cid", "members"])

    return arrow_map(docs, collect, "cid long, members binary")


def is_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < PERCENT * len(y):
        return False
    at = np.searchsorted(y, x)
    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that are links by their full sets."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True)
        ok = [is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both]
        return batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.select("x", "y").join(sets.select(F.col("cid").alias("x"), F.col("members").alias("sx")), "x").join(sets.select(F.col("cid").alias("y"), F.col("members").alias("sy")), "y")
    return arrow_map(full, check, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (x, y), by labels that spread and jump until none changes."""
    both = materialise(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumn("moved", F.lit(True)))
    while labels.where("moved").limit(1).count():
        seen = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("seen"))
        low = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        labels = materialise(low.join(jump, "low").select("node", F.least("low", "beyond").alias("root"), (F.least("low", "beyond") < F.col("was")).alias("moved")))
    return labels.select("node", "root")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after more links between nodes."""
    root = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias("r" + name))
    between = links.join(root("x"), "x", "left").join(root("y"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")).where("x <> y")
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("onto"))
    old = labels.join(moved, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    new = moved.select(F.col("root").alias("node"), F.col("onto").alias("root")).join(labels.select("node"), "node", "left_anti")
    return materialise(old.unionByName(new))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    root = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias("r" + name))
    joined = pairs.join(root("x"), "x", "left").join(root("y"), "y", "left")
    return joined.where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select(*pairs.columns)


def blocks_of_buckets(members: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(bucket, rows, rows2): blocks of members (bucket, cid) that meet, for buckets with more than one component.

    A bucket is dealt into blocks of about BLOCK rows of usual length: a component of many members has blocks of its
    own, small ones share blocks. Two blocks of one component do not meet. ``rows``: columns by cid, with n among them.
    """
    placed = members.join(labels.select(F.col("node").alias("cid"), F.col("root").alias("comp")), "cid", "left").select("bucket", "cid", F.coalesce("comp", "cid").alias("comp"))
    weight = F.greatest(F.lit(1.0), F.col("n") / USUAL)
    placed = placed.join(rows.select("cid", weight.alias("weight")), "cid")
    by_comp = placed.groupBy("bucket", "comp").agg(F.sum("weight").alias("in_comp"))
    buckets = by_comp.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.sum(F.when(F.col("in_comp") < BLOCK, F.col("in_comp"))).alias("small")).where("comps > 1")
    sized = placed.join(by_comp, ["bucket", "comp"]).join(buckets, "bucket")
    large = F.col("in_comp") >= BLOCK
    parts = F.ceil(F.when(large, F.col("in_comp")).otherwise(F.col("small")) / BLOCK)
    name = F.concat_ws(":", F.when(large, F.col("comp")), F.pmod(F.xxhash64(F.when(large, F.col("cid")).otherwise(F.col("comp"))), parts))
    full = sized.select("bucket", name.alias("block"), F.when(large, F.col("comp")).alias("whole"), "cid", "comp").join(rows, "cid")
    own = [c for c in full.columns if c not in ("bucket", "block", "whole")]
    blocks = materialise(full.groupBy("bucket", "block").agg(F.first("whole").alias("whole"), F.collect_list(F.struct(*own)).alias("rows")))
    # Pairs of names first: the rows then meet under (bucket, block), so that a bucket of many blocks is no single task.
    names = blocks.select("bucket", "block", "whole")
    other = names.select("bucket", F.col("block").alias("block2"), F.col("whole").alias("whole2"))
    met = names.join(other, "bucket").where((F.col("block") <= F.col("block2")) & (F.col("whole").isNull() | F.col("whole2").isNull() | (F.col("whole") != F.col("whole2")))).select("bucket", "block", "block2")
    second = blocks.select("bucket", F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    return met.join(blocks.select("bucket", "block", "rows"), ["bucket", "block"]).join(second, ["bucket", "block2"]).select("bucket", "rows", "rows2")


def close_rows(bucket: int, x: pa.StructArray, y: pa.StructArray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of x, each with the rows of y of other components whose estimate passes, best first.

    A pair counts in the first bucket that it shares.
    """
    (cx, nx, rx), (cy, ny, ry) = ((s.field("comp").to_numpy(), s.field("n").to_numpy(), np.frombuffer(b"".join(s.field("regs").to_pylist()), np.uint16).reshape(-1, M)) for s in (x, y))
    own, keys = band_keys(rx), band_keys(ry)
    for i in range(len(cx)):
        near = np.flatnonzero((cy != cx[i]) & (np.minimum(ny, nx[i]) * 100 >= np.maximum(ny, nx[i]) * PERCENT))
        near = near[(ry[near] == rx[i]).sum(axis=1) >= M * (PERCENT / 100 - 2 * SLACK)]
        near = near[keys[near, (keys[near] == own[i]).argmax(axis=1)] == bucket]
        if len(near):
            est = likely_similarity((rx[i] > ry[near]).sum(axis=1), (rx[i] < ry[near]).sum(axis=1), np.full(len(near), nx[i]), ny[near])
            order = np.argsort(-est, kind="stable")[: int((est >= PERCENT / 100 - SLACK).sum())]
            if len(order):
                yield i, near[order]


def rest_of_buckets(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y): links between classes of one bucket but of different components, one for a class and a component.

    Registers alone first tell which classes have anything close in another component of a bucket. Those meet again
    with their full sets, and pairs are verified in place: nothing but links leaves a block.
    """

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, cids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, bucket in enumerate(batch.column("bucket").to_pylist()):
            x, y = batch.column("rows")[r].values, batch.column("rows2")[r].values
            found = list(close_rows(bucket, x, y))
            some = np.unique(np.concatenate([x.field("cid").to_numpy()[[i for i, _ in found]], *(y.field("cid").to_numpy()[near] for _, near in found)])) if found else cids[0]
            buckets.append(np.full(len(some), bucket))
            cids.append(some)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(cids))], names=["bucket", "cid"])

    def link(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r, bucket in enumerate(batch.column("bucket").to_pylist()):
            x, y = batch.column("rows")[r].values, batch.column("rows2")[r].values
            sx, sy = ([np.frombuffer(m, np.uint64) for m in s.field("members").to_pylist()] for s in (x, y))
            ix, iy, comp = x.field("cid").to_numpy(), y.field("cid").to_numpy(), y.field("comp").to_numpy()
            for i, near in close_rows(bucket, x, y):
                linked: set[int] = set()
                for j in near.tolist():
                    if comp[j] not in linked and is_link(sx[i], sy[j]):
                        linked.add(comp[j])
                        out.append((min(ix[i], iy[j]), max(ix[i], iy[j])))
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["x", "y"])

    involved = materialise(arrow_map(blocks_of_buckets(members, labels, classes.select("cid", "n", "regs")), close, "bucket long, cid long").distinct())
    some = classes.select("cid", "n", "regs").join(involved.select("cid").distinct(), "cid", "left_semi").join(sets, "cid")
    return arrow_map(blocks_of_buckets(involved, labels, materialise(some)), link, "x long, y long").distinct()


@tidied
def near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``, by shingles of ``k`` words."""
    found = materialise(sketches(docs, k))
    key = ["n", "a", "b"]
    classes = materialise(found.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("cid"), F.first("regs").alias("regs")))
    bands = banded(classes)
    # Every bucket has its first class as a leader, and every fourth one more that is drawn by hash.
    draw = F.min(F.when(F.pmod("bucket", F.lit(4)) == 0, F.struct(F.xxhash64("bucket", "cid"), F.col("cid").alias("cid"))))["cid"]
    leaders = bands.groupBy("bucket").agg(F.min("cid").alias("first"), draw.alias("drawn"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = materialise(bands.join(leaders, "bucket"))
    pairs = members.select(F.explode(F.array("first", "drawn")).alias("x"), F.col("cid").alias("y")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    passed = materialise(estimated(pairs, classes))
    wanted = docs.select(whole_id(docs).alias("cid"), "text").join(members.select("cid").distinct(), "cid", "left_semi")
    sets = materialise(full_sets(wanted, k).dropDuplicates(["cid"]))
    best = passed.groupBy("y").agg(F.max(F.struct("est", "x"))["x"].alias("x")).select("x", "y")
    labels = components(materialise(verified(best, sets)))
    labels = merged(labels, materialise(verified(across(passed, labels), sets)))
    labels = merged(labels, materialise(rest_of_buckets(members.select("bucket", "cid"), labels, classes, sets)))
    by_class = classes.join(labels.select(F.col("node").alias("cid"), "root"), "cid", "left").select(*key, F.coalesce("root", "cid").alias("root"))
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("root")).otherwise(F.col("doc_id"))
    joined = found.drop("regs").join(by_class, key, "left").withColumn("component_id", component)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@tidied
def deduplicated(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` without the rows that are not the first of their component; rows without doc_id come after those with one, in any order."""
    own, name = fresh_name(docs, "own"), fresh_name(docs, "gone")
    docs = with_own_ids(docs, own, 1 << 62)
    gone = near_duplicates(docs.select(F.col(own).alias("doc_id"), "text"), k).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[own] == gone[name], "left_anti").drop(own)


ORACLE_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
         n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
         e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
         i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
         l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
         u AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
         r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other)
    SELECT r.doc_id, any_value(n.n) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
