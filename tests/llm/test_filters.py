"""Arrays and filters of line dedup that tasks make together."""

from contextlib import contextmanager

import numpy as np

from shardmend.llm import linededup


@contextmanager
def held_partitions(spark, n):
    """``n`` shuffle partitions that are not put together."""
    names = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_jobs_do_not_grow_with_partitions(spark):
    docs = spark.createDataFrame([(i, f"one two w{i}") for i in range(50)], "doc_id long, text string").repartition(5)
    with held_partitions(spark, 24):
        spark.sparkContext.setJobGroup("counts", "counts")
        counts = linededup.token_counts(docs)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts.sum() == 150 and sorted(counts[counts > 0].tolist())[-2:] == [50, 50]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counts")) < 10


def test_arrays_of_many_tasks_are_joined_once_each(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FAN", 2)
    docs = spark.createDataFrame([(i, f"one w{i}") for i in range(90)], "doc_id long, text string").repartition(9)
    counts = linededup.token_counts(docs)
    assert counts.sum() == 180 and counts.max() >= 90


def test_the_driver_sets_the_bits_that_tasks_set(spark, monkeypatch):
    rows = [(int(d), int(d) % 7) for d in np.random.default_rng(5).integers(-(1 << 40), 1 << 40, 3000)]
    lines = spark.createDataFrame(rows + rows[:100], "d long, l long").repartition(6)
    own = linededup.filter_over(lines)
    monkeypatch.setattr(linededup, "FEW_ROWS", 10)
    assert np.array_equal(own, linededup.filter_over(lines))
    d, l = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    assert linededup.passes(own, d, l).all() and linededup.passes(own, d + 1, l).mean() < 0.1
    assert not linededup.filter_over(lines.where("d IS NULL")).any()
