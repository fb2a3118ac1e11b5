"""State by key over a stream: rows that come late, equal versions, rows without key or version."""

import time

from pyspark.sql import functions as F

from shardmend.plans.recipe import Recipe, Step, apply_recipe
from shardmend.sources import markers
from shardmend.streaming import versions


def run(spark, folder, batches, schema, made):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = made(stream)
    done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/out").collect()


def test_only_what_advances_is_given_out(spark, tmp_path):
    batches = [
        [("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 1, "n"), ("c", None, "none")],
        [("a", 2, "again"), ("a", 1, "late"), ("b", 7, "next"), ("b", 6, "between")],
        [("b", 4, "late"), ("c", 1, "first"), (None, 3, "n")],
    ]
    got = run(spark, tmp_path, batches, "k string, v long, what string", lambda s: versions.advancing(s, "k", "v"))
    expect = {("a", 1, "y", 1), ("a", 2, "x", 2), ("b", 5, "z", 1), ("b", 6, "between", 2), ("b", 7, "next", 3), ("c", 1, "first", 1), (None, 1, "n", 1), (None, 3, "n", 2)}
    assert {tuple(r) for r in got} == expect and len(got) == len(expect)


def test_seeds_count_up_by_frame(spark, tmp_path):
    photos = {v: markers.fake_photo(v, 300 + v) for v in range(4)}
    recipe = Recipe([Step("bitflip", {"rate": 400}, 3), Step("requantize")])
    got = run(spark, tmp_path, [[("k", 0, photos[0]), ("k", 2, photos[2])], [("k", 1, photos[1]), ("k", 3, photos[3])]], "k string, v long, bytes binary", lambda s: versions.live_frames(s, "k", "v", recipe, seed=10))
    assert sorted((r["v"], r["frame"]) for r in got) == [(0, 1), (2, 2), (3, 3)]
    plain = spark.createDataFrame([(v, photos[v], 10 + i) for i, v in enumerate((0, 2, 3))], "v long, bytes binary, seed long")
    expect = {r["v"]: r["bytes"] for r in apply_recipe(plain, Recipe(recipe.nodes[:1]), seed="seed").select("v", F.col("bytes")).collect()}
    assert {r["v"]: r["bytes"] for r in got} == expect


def test_what_advances_is_kept_by_batch(spark, tmp_path):
    """Batches of one run each, against a plain walk: late rows, repeats, null keys and versions, keys that come once."""
    import random

    from shardmend.streaming import versions

    r, newest, expect = random.Random(5), {}, []
    stream = spark.readStream.schema("k string, v long").parquet(f"{tmp_path}/in/*")
    for part in range(3):
        rows = [(r.choice(["a", "b", "c", None, f"n{part}"]), r.choice([None, *range(30)])) for _ in range(25)]
        spark.createDataFrame(rows, "k string, v long").repartition(3).write.parquet(f"{tmp_path}/in/part{part}")
        versions.keep_advancing(stream, "k", "v", f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
        seen = dict(newest)
        for k, v in sorted({x for x in rows if x[1] is not None}, key=lambda x: x[1]):
            if v > seen.get(k, (-1, 0))[0]:
                newest[k] = v, newest.get(k, (-1, 0))[1] + 1
                expect.append((k, v, newest[k][1]))
    got = [(x["k"], x["v"], x["frame"]) for x in spark.read.parquet(f"{tmp_path}/out/rows").collect()]
    assert sorted(got, key=str) == sorted(expect, key=str) and len(expect) > 10
