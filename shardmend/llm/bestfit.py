"""Best-fit packing planned over a histogram of lengths.

Texts become token ids with an end id, and only what is longer than a sequence is cut. The plan looks at counts of
lengths alone: from the longest length down, pieces go to the open sequences with the least room that takes them, whole
runs of equal sequences at a time. It is a table of slots by (length, rank), which holds at most one row for each run of
equal sequences and each length, whatever the input holds. Pieces get their rank within their length and join the plan.

Ids are those of the tokenizer over the whole text; strings of special tokens in it are ordinary text. Very long texts go
through the tokenizer in parts, cut before a space that a visible character follows, where its rules always begin a token.

Null and empty texts are the end id alone. A very long text is held with its ids by one task and is cut from its end, so
that its first piece is the shorter one. Rows without doc_id draw by their text; pieces of equal draws are in order of
id, piece and content, and rows that repeat an id are pieces of their own. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import id_key, lean, materialise, ranked, strings, tidied

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
SEED = "fit-1"
#: Pieces of a length that are ranked in one task, about.
SHARD_ROWS = 10_000
#: Characters of a text that are tokenised at once, about.
STEP = 1 << 20

#: A space before a character that is no white space or control character in any reading.
_SPLIT = re.compile(r" (?=[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff])")


def byte_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Ranks of byte strings, from the JSON of a byte-level BPE; None for other tokenizers and where merges aren't in the order of ids."""
    found = json.loads(vocabulary)
    model, before = found["model"], found.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and found.get("normalizer") is None
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges"):
        return None
    # Byte-level vocabularies write bytes as characters: those that show as they are, the others from 256 on.
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    return {bytes(byte_of[c] for c in x): i for x, i in model["vocab"].items() if i < 256 + len(pairs)}


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Ids of a text, special strings in it being ordinary. Plain byte-level BPE is done by ranks, which is several times faster."""
    ranks = byte_ranks(vocabulary)
    if ranks is not None:
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokenizer = tokenizers.Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(text: str, encode: Callable[[str], list[int]], step: int = STEP) -> np.ndarray:
    """Ids of a text, a part of about ``step`` characters at a time."""
    out, at = [], 0
    while len(text) - at > step and (cut := _SPLIT.search(text, at + step)):
        out.append(np.array(encode(text[at : cut.start()]), "<u4"))
        at = cut.start()
    out.append(np.array(encode(text[at:]), "<u4"))
    return np.concatenate(out)


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, seed: str = SEED) -> DataFrame:
    """(doc_id, u, piece, start, length, ids_crc32): the pieces of every text, with their ``ids`` if asked for.

    The vocabulary travels with the job, so executors need no file; ``u`` is the number that pieces draw.
    """
    with open(tokenizer_path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = f.read()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, number, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(strings(batch.column("text"))):
                own = np.append(ids_of(text, encode), np.array([end], "<u4"))
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                rows += [r] * (len(cuts) - 1)
                number += range(len(cuts) - 1)
                start += cuts[:-1]
                length += np.diff(cuts).tolist()
                cut = [own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                crc += map(zlib.crc32, cut)
                if with_ids:
                    ids += cut
            at = pa.array(rows, pa.int64())
            out = [batch.column("doc_id").take(at), batch.column("draw").take(at), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "draw", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.binary())] if with_ids else []), names=names + (["ids"] if with_ids else []))

    draw = F.xxhash64(F.lit(seed), id_key(F.col("doc_id"), F.col("text")))
    schema = f"doc_id {kind}, draw long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    cut = docs.select("doc_id", draw.alias("draw"), "text").mapInArrow(lean(run), schema)
    u = F.shiftrightunsigned(F.xxhash64("draw", "piece"), 12) / F.lit(float(1 << 52))
    return cut.select("doc_id", u.alias("u"), *[c for c in cut.columns if c not in ("doc_id", "draw")])


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots as runs (length, rank, pieces, sequence, offset, per).

    The pieces of ``length`` with ranks from ``rank`` on go to sequences from ``sequence`` on, ``per`` of them side by
    side in each, the first at ``offset``. Lengths go from the longest down, each to the open sequences of least room
    that take it, then to new ones. Sequences that were filled alike stay together as one run.
    """
    room_of: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for room in range(length, capacity + 1):
            per = room // length
            while left and (room == capacity or room_of[room]):
                first, n = room_of[room].pop() if room < capacity else (opened, -(-left // per))
                opened += n if room == capacity else 0
                taken = min(left, n * per)
                runs.append((length, rank, taken, first, capacity - room, per))
                full, rest = divmod(taken, per)
                for begin, size, space in ((first, full, room - per * length), (first + full, int(rest > 0), room - rest * length), (first + full + (rest > 0), n - full - (rest > 0), room)):
                    if size and space:
                        room_of[space].append((begin, size))
                rank, left = rank + taken, left - taken
            if not left:
                break
    return runs


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` pieces with sequence_id and offset. ``cut`` is read several times."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # a row for each length up to the capacity
    spark = cut.sparkSession
    plan = spark.createDataFrame(best_fit(counts, capacity) or [(0, 0, 0, 0, 0, 1)], "of long, first_rank long, n long, first long, at long, per long")
    shards = spark.createDataFrame([(k, v // SHARD_ROWS + 1) for k, v in counts.items()] or [(0, 1)], "length long, shards long")
    dealt = cut.join(F.broadcast(shards), "length")
    shard = F.floor(F.col("u") * F.col("shards")).cast("long")
    order = [F.col(c) for c in ("u", "doc_id", "piece", "ids_crc32")]
    with_rank = ranked(dealt, ["length"], order, shard, "rank", dealt.select("length", "u", "shards"))
    slot = F.col("rank") - F.col("first_rank")
    met = with_rank.join(F.broadcast(plan), (F.col("length") == F.col("of")) & (slot >= 0) & (slot < F.col("n")))
    sequence = F.col("first") + F.floor(slot / F.col("per")).cast("long")
    offset = F.col("at") + slot % F.col("per") * F.col("length")
    return met.select(*[c for c in cut.columns if c != "u"], sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


@tidied
def packed_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every text."""
    return placed(materialise(pieces(docs, tokenizer_path, capacity, end)), capacity)


@tidied
def sequences(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, length, ids, doc_ids, offsets): the sequences themselves, ids in order, and which text stands where.

    A sequence has no more pieces than the capacity, so each is put together in one row.
    """
    found = placed(materialise(pieces(docs, tokenizer_path, capacity, end, with_ids=True)), capacity)
    whole = found.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    whole = whole.select("sequence_id", "length", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))
    kind = dict(found.dtypes)["doc_id"]

    def as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids if c == "ids" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return whole.mapInArrow(lean(as_lists), f"sequence_id long, length long, ids array<int>, doc_ids array<{kind}>, offsets array<long>")
