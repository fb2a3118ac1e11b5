"""What a Python task holds doesn't grow with the batches that it is given, whatever bounds the session sets for them."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from shardmend.functions.prng import Pcg32
from shardmend.operators import marker_steps  # noqa: F401  (adds its steps)
from shardmend.operators.seeded_steps import run_step, seeded

HEAD = bytes.fromhex("FFD8" + "FFE200104943435F50524F46494C45000101" + "FFDB004300" + "01" * 64 + "FFC00011080010001003012200021101031101" + "FFDA000C03010002110311003F00")
N, LENGTH = 60, 500_000


class OneBatch(SimpleNamespace):
    """Stands in for a DataFrame: what a function makes of a single batch of all rows, and the most that it held meanwhile."""

    def select(self, *names):
        return OneBatch(batch=self.batch.select(names), dtypes=self.dtypes, schema=self.schema)

    def mapInArrow(self, run, schema):
        rows, arrow, most = [], pa.total_allocated_bytes(), 0
        tracemalloc.start()
        for out in run(iter([self.batch])):
            most = max(most, pa.total_allocated_bytes() - arrow)
            rows += [{k: hash(v) if k == "bytes" else v for k, v in row.items()} for row in out.to_pylist()]
        most += tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most


def held(key: str, payloads: list[bytes]) -> OneBatch:
    batch = pa.RecordBatch.from_pydict({key: pa.array(range(len(payloads)), pa.int64()), "bytes": pa.array(payloads, pa.binary())})
    return OneBatch(batch=batch, dtypes=[(key, "bigint"), ("bytes", "binary")], schema=None)


def photo(i: int) -> bytes:
    return HEAD + bytes([i]) * LENGTH + b"\xff\xd9"


def check_step(name: str, **params) -> None:
    """30 MB of payloads in one batch: each is damaged as by itself, and a few of them are held at once."""
    payloads = [photo(i) for i in range(N)]
    rows, most = seeded(held("seed", payloads), name, **params)
    assert rows == [{"seed": i, "bytes": hash(run_step(name, p, Pcg32(i), params))} for i, p in enumerate(payloads)]
    assert most < 20_000_000


def test_stuttered_reads_hold_a_piece_of_a_batch():
    check_step("stutter_read", cluster_kb=1)


def test_scaled_tables_hold_a_piece_of_a_batch():
    check_step("qtable_decode_swap", factor=2.5)


def test_lost_profiles_hold_a_piece_of_a_batch():
    check_step("icc_loss")


@pytest.mark.parametrize("sizes", [[], [0], [3] * 2000, [5_000_000, 1, 5_000_000], [100_000] * 100, [0] * 1025])
def test_pieces_are_whole_and_bounded(sizes):
    from shardmend.functions.batches import BATCH_BYTES, BATCH_ROWS, small

    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(len(sizes)), pa.int64()), "bytes": pa.array([b"x" * n for n in sizes], pa.binary())})
    pieces = list(small([batch, batch]))
    assert [i for p in pieces for i in p.column("i").to_pylist()] == 2 * list(range(len(sizes)))
    assert [len(b) for p in pieces for b in p.column("bytes").to_pylist()] == 2 * sizes
    assert all(p.num_rows <= BATCH_ROWS and (p.nbytes <= BATCH_BYTES or p.num_rows == 1) for p in pieces)


def test_recipes_hold_a_piece_of_a_batch():
    from shardmend.plans.recipe import Recipe, Step, apply_recipe

    payloads = [photo(i) for i in range(N)]
    rows, most = apply_recipe(held("idx", payloads), Recipe([Step("ransomware", {"kb": 1}, 7)]), seed="idx")
    assert rows == [{"idx": i, "bytes": hash(run_step("ransomware", p, Pcg32(7 + i), {"kb": 1}))} for i, p in enumerate(payloads)]
    assert most < 20_000_000


def test_clips_taken_apart_hold_a_piece_of_a_batch():
    from shardmend.sources import clips

    payloads = [photo(i) for i in range(N)]
    rows, most = clips.clip_frames(held("clip_id", [clips.muxed([p, p[::-1]], 10.0, 16, 16) for p in payloads]))
    assert rows == [{"clip_id": i, "idx": k, "fps": 10.0, "bytes": hash(frame)} for i, p in enumerate(payloads) for k, frame in enumerate((p, p[::-1]))]
    assert most < 20_000_000
