"""What steps are, as data: layer, draws, donors, ranges of parameters; clamps, and an analysis of recipes as tables."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardmend.plans.recipe import MOST_TURNS, Step

# Steps with their layer, r where they draw and p where they take another payload, and their parameters as
# name:kind[:low:high|:choices]; kinds are i (whole), f (real), b (yes or no), e (one of), t (text), o (a payload of the pool).
STEPS = """
truncate byte - percent:f:0:100 byte:i:-1:1073741824
bitflip byte r rate:f:0.1:200 start:f:0:100 end:f:0:100
byte_delete byte r count:i:1:1000 length:i:1:1048576 start:f:0:100 end:f:0:100
byte_insert byte r count:i:1:1000 length:i:1:65536 hex:t start:f:0:100 end:f:0:100
fake_marker byte r marker:e:eoi,rst,sos,soi,dht,random count:i:1:100 start:f:0:100 end:f:0:100
zero_run byte r count:i:1:100 length:i:1:1048576 start:f:0:100 end:f:0:100
dc_offset coeff - component:e:0,1,2 amount:i:-255:255 at:f:0:100
restart_markers coeff - interval:i:-1:4096
rst_strip_loss byte r count:i:1:100 behaviour:e:collapse,gaps
byte_swap16 byte - start:f:0:100 end:f:0:100
splice byte rp photo:o at:f:0:100 clusters:i:1:256 cluster_kb:e:4,8,16,32 mode:e:replace,insert
cbcr_swap byte -
header_graft byte p photo:o skip:i:0:67108864 keep_exif:b neutralise_markers:b
sof_dims byte - width:i:0:16384 height:i:0:16384 width_delta:i:-256:256 height_delta:i:-2048:2048
huffman_swap byte p source:e:photo,standard photo:o
ftp_ascii byte r direction:e:lf_to_crlf,crlf_to_lf portion:f:0.02:1
seven_bit byte - start:f:0:100
base64_damage byte r lines:i:1:100 mode:e:drop,garble
interrupted_download byte - percent:f:0:100 progressive:b
mms_recompress pixel - size_kb:i:5:600
ransomware_partial byte r kb:i:1:16384
repair_tool coeff - strength:f:0:1
mjpeg_no_dht byte - mode:e:insert_std,none
mpf_ghost pixel - kind:e:gain_map,depth,preview
exif_orientation meta - value:e:0,1,2,3,4,5,6,7,8
exif_thumb_mismatch meta p photo:o
exif_corrupt meta r rate:f:0:1
strip_exif meta - mode:e:private,all
color_matrix pixel -
channel_drop coeff - component:e:0,1,2 mode:e:zero,flat,negate
icc_loss pixel -
progressive_cut byte - scans:i:1:10
progressive_drop_dc byte -
requantize pixel - quality:i:1:100 swap_tables:b
qtable_decode_swap byte - mode:e:scale,swap,table factor:f:0.1:8 quality:i:1:100
coeff_kill coeff - from:i:0:63 to:i:0:63 component:e:all,0,1,2
coeff_paint coeff - mode:e:zero,boost,harsh strength:f:0:1
chroma_subsample pixel - shift_x:i:-16:16 shift_y:i:-16:16 passes:i:1:20
resave pixel r generations:i:1:100 quality:i:1:100 quality_jitter:i:0:40 shift:i:0:8 crop:i:0:16 resize:i:0:25
reencode_profile pixel - keep_size:b
encode_like_photo pixel p photo:o
displace byte rp shifts:i:1:4 lost_kb:f:-16:64 seam_x:f:0:1 first_row:f:0:0.9 top_garbage_kb:f:0:8 foreign_from:f:0:1 foreign_photo:o
sensor_noise pixel r amount:f:0:1
oversharpen pixel - amount:f:0:1
purple_fringe pixel - amount:f:0:1
date_stamp pixel - text:t
pass_through_card card rp severity:i:1:10 neighbours:i:1:8
interleave card p photo:o period:i:1:16 start:f:0:100 cluster_kb:i:1:128
cross_link card p photo:o at:f:0:100 cluster_kb:i:1:128
stutter_read card r count:i:1:32 cluster_kb:i:1:128 protect_header:b
dropped_sectors card r count:i:1:256 protect_header:b
tool_fill_pattern card r count:i:1:64 sectors:i:1:64 protect_header:b
chipoff_xor card r key_len:i:1:4096 page_kb:i:2:16 strength:f:0:100 start:f:0:100 shuffle:b
flash_fault card r mode:e:erased,burst,stuck_bit,zero count:i:1:64 page_kb:i:2:16
recuva_contiguous card p photo:o fragment_at:f:1:99 cluster_kb:i:1:128
"""


def _read() -> dict[str, dict]:
    out = {}
    for line in STEPS.split("\n"):
        if not line.strip():
            continue
        name, layer, marks, *params = line.split()
        out[name] = {"layer": layer, "random": "r" in marks, "pool": "p" in marks, "params": {p.split(":")[0]: p.split(":")[1:] for p in params}}
    return out


CATALOGUE = _read()


def clamped(step: Step) -> Step:
    """A step whose numbers lie in their ranges, whole where they must be; choices that don't exist fall back to the step's own."""
    known, out = CATALOGUE.get(step.id, {"params": {}})["params"], {}
    for name, value in step.params.items():
        kind, *bounds = known.get(name, ["t"])
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if kind in ("i", "f") and number:
            low, high = map(float, bounds)
            value = min(max(value, low), high)
            value = math.floor(value + 0.5) if kind == "i" else float(value)
        elif kind == "e" and isinstance(value, str) and value not in bounds[0].split(","):
            continue
        out[name] = value
    return replace(step, params=out)


def as_table(spark: SparkSession) -> DataFrame:
    """(id, layer, random, pool): a row for each step."""
    return spark.createDataFrame([(n, s["layer"], s["random"], s["pool"]) for n, s in CATALOGUE.items()], "id string, layer string, random boolean, pool boolean")


STEP = "struct<uid:string,type:string,id:string,enabled:boolean"
RECIPE = f"struct<steps:array<{STEP},times:double,children:array<{STEP}>>>>>"


def recipe_nodes(recipes: DataFrame, turns: int = 2) -> DataFrame:
    """(recipe_id, place, uid, type, id): the steps and patches that run, in order, of recipes (recipe_id, json) held as rows.

    A repeat gives its steps at most ``turns`` times; nodes and steps that are off give nothing.
    """
    steps = F.from_json("json", RECIPE)["steps"]
    on = lambda n: F.coalesce(n["enabled"], F.lit(True))
    one = lambda n: F.struct(n["uid"].alias("uid"), F.coalesce(n["type"], F.lit("step")).alias("type"), n["id"].alias("id"))
    kids = lambda n: F.transform(F.filter(F.coalesce(n["children"], F.array()), on), one)
    times = lambda n: F.least(F.greatest(F.floor(F.coalesce(n["times"], F.lit(1.0))), F.lit(0)), F.lit(min(turns, MOST_TURNS))).cast("int")
    flat = F.flatten(F.transform(F.filter(steps, on), lambda n: F.when(n["type"] == "repeat", F.flatten(F.array_repeat(kids(n), times(n)))).otherwise(F.array(one(n)))))
    return recipes.select("recipe_id", F.posexplode(flat).alias("place", "n")).select("recipe_id", "place", "n.uid", "n.type", "n.id")


def reencode_marks(recipes: DataFrame) -> DataFrame:
    """(recipe_id, uid): nodes of recipes (recipe_id, json) where a picture is decoded that an earlier step changed as bytes.

    What counts is the last layer before a node that isn't only notes: bytes, a card or a patch make it dirty, pixels and
    coefficients write it anew. A window over each recipe carries it forward; the steps' layers join from the catalogue,
    a table of one row for each step there is.
    """
    nodes = recipe_nodes(recipes)
    layers = as_table(recipes.sparkSession).select("id", "layer")
    layer = F.when(F.col("type") == "patch", "byte").otherwise(F.col("layer"))
    placed = nodes.join(F.broadcast(layers), "id", "left").withColumn("layer", layer).withColumn("counts", F.when(F.col("layer").isin("byte", "card", "pixel", "coeff"), F.col("layer")))
    before = F.last("counts", ignorenulls=True).over(W.partitionBy("recipe_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("before", before).where("layer IN ('pixel', 'coeff') AND before IN ('byte', 'card')").select("recipe_id", "uid").distinct()
