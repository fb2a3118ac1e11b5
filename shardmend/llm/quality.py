"""Quality classifier: a generalised additive model with pairwise interactions.

Features are statistics of the bytes and words of the whole text. The model is a lookup table for each feature and for
each chosen pair of features. Boosting goes round the features; each turn fits a shallow tree on the feature's bins and
adds its leaves, shrunken, to the table. Pairs are chosen by what they explain of the residuals and boosted the same
way on coarser bins. A score is a sum of table entries at the text's bins through a logistic function.

Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1, and the model is fitted on at most SAMPLE of
them, those of least hash. Null and empty texts have features of 0 and get a score like any other. Labels without
quality are left out; where a doc_id has several, the lowest counts; of texts that share a labelled doc_id the least is
learned from. Without labels every score is 0.5. Rows that repeat share a score. Very long texts are read whole, in a
buffer of their own. An empty table gives no rows. Other columns pass under any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import BUFFER, arrow_map, fresh_name, row_groups, utf8, word_hashes

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAVES = 120, 40, 0.15, 5.0, 4
NAMES = ("log_bytes", "upper", "digit", "symbol", "bang", "bar", "stop", "space", "line_ends", "high_bytes", "word_length", "adjacent_repeats", "distinct_words", "words_per_line")

#: Byte classes: 0 other, 1 upper case, 2 digit, 3 symbol, 4 exclamation, 5 bar, 6 full stop or comma, 7 space, 8 line end, 9 not ASCII.
_CLASS = np.zeros(256, np.int64)
for _n, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+<=>@^_`{}~\\", b"!", b"|", b".,", b" \t", b"\n\r"), 1):
    _CLASS[list(_of)] = _n
_CLASS[128:] = 9
_KINDS = 10


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of features for each text of a buffer."""
    rows = len(starts) - 1
    size = np.diff(starts)
    row = np.repeat(np.arange(rows) * _KINDS, size)
    kinds = np.bincount(row + _CLASS[data], minlength=rows * _KINDS).reshape(rows, _KINDS)
    h, of, begin, end = word_hashes(data, starts)
    words = np.bincount(of, minlength=rows)
    letters = np.bincount(of, end - begin, minlength=rows)
    repeats = np.bincount(of[1:], (h[1:] == h[:-1]) & (of[1:] == of[:-1]), minlength=rows) if len(h) else np.zeros(rows)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[new], minlength=rows)
    per, word = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    # Distinct words grow slower than words: their number over the power 0.8 stays of one order.
    return np.column_stack([np.log1p(size), kinds[:, 1:] / per, letters / word, repeats / word, distinct / word**0.8, words / (kinds[:, 8] + 1)])


@dataclass
class Model:
    """Cut points and tables by feature; pairs of features with coarse cut points and tables."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values by bin of a tree grown best split first on gradient and curvature sums of ordered bins."""
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + RIDGE)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    parts = [(0, len(g))]
    while len(parts) < leaves:
        (gain, cut), part = max((best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of logistic loss on the features, then on the best pairs."""
    n, width = x.shape if len(x) else (0, len(NAMES))
    cuts = [_quantiles(x[:, j] if n else x, BINS) for j in range(width)]
    coarse = [_quantiles(x[:, j] if n else x, PAIR_BINS) for j in range(width)]
    model = Model(float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [])
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    total = np.full(n, model.base)
    slope = lambda: y - 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    for _ in range(ROUNDS):
        for j in range(width):
            r = slope()
            p = y - r
            step = RATE * _tree(np.bincount(at[j], r, len(cuts[j]) + 1), np.bincount(at[j], p * (1 - p), len(cuts[j]) + 1), LEAVES)
            model.tables[j] += step
            total += step[at[j]]
    low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]
    wide = PAIR_BINS + 1
    r = slope()
    p = y - r

    def gain(a: int, b: int) -> float:
        cell = low[a] * wide + low[b]
        g, h = np.bincount(cell, r, wide * wide), np.bincount(cell, p * (1 - p), wide * wide)
        return float((g**2 / (h + RIDGE)).sum())

    chosen = sorted(((gain(a, b), a, b) for a in range(width) for b in range(a + 1, width)), reverse=True)[:PAIRS]
    tables = {(a, b): np.zeros((wide, wide)) for _, a, b in chosen}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in tables.items():
            r = slope()
            p = y - r
            cell = low[a] * wide + low[b]
            g, h = np.bincount(cell, r, wide * wide).reshape(wide, wide), np.bincount(cell, p * (1 - p), wide * wide).reshape(wide, wide)
            # A tree of depth two: the first feature parts the cells in two, the second parts each of them.
            side = _tree(g.sum(axis=1), h.sum(axis=1), 2)
            first = side == side[0]
            step = np.zeros((wide, wide))
            for part in (first, ~first):
                if part.any():
                    step[part] = RATE * _tree(g[part].sum(axis=0), h[part].sum(axis=0), 2)
            table += step
            total += step[low[a], low[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with an array of features of its text."""
    types = dict(docs.dtypes)

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8(batch.column("text"))
        x = np.concatenate([features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]) for i, j in row_groups(starts, BUFFER)])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.FixedSizeListArray.from_arrays(x.ravel(), len(NAMES)).cast(pa.list_(pa.float64()))], names=[*keep, "features"])

    return arrow_map(docs.select(*keep, "text"), compute, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "features array<double>"]))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted on up to ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    # Of rows that repeat a doc_id one counts, so that the sample stays within its bound.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = feature_rows(rows.select("doc_id", "quality", "text"), ["doc_id", "quality"]).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = found.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return fit(x, found.column("quality").to_numpy().astype(float))


def scored(docs: DataFrame, model: Model, name: str = "_quality") -> DataFrame:
    """``docs`` with a column ``name``: the score of each text. Other columns pass unread."""
    names = docs.columns

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8(batch.column("text"))
        s = np.concatenate([model.score(features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])) for i, j in row_groups(starts, BUFFER)])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s)], names=[*names, name])

    return arrow_map(docs, score, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` double"]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    done = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model rejects, under their own columns."""
    name = fresh_name(docs, "quality")
    return scored(docs, learned(docs, labels), name).where(F.col(name) >= 0.5).drop(name)
