"""Recipes with the status of every node: what ran, what failed and why, what was off, stale or not there.

The state of a payload is its bytes, the results of its nodes so far and the error of the node at work. Column expressions
become projections, and neighbouring kernels share one pass over Arrow batches that carries the whole state, so statuses
cost no second run. A node that fails passes its input on; a repeat that fails ends with what its turns have made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.functions.batches import small
from shardmend.functions.hashes import has_hash
from shardmend.functions.prng import Pcg32
from shardmend.operators.byte_steps import STEPS
from shardmend.operators.seeded_steps import try_step
from shardmend.plans.recipe import Patch, Recipe, Repeat, Step, native_step, patched, seeded_name, unrolled

RESULT = "array<struct<node:int,status:string,error:string,size:long>>"
_RESULT = pa.list_(pa.struct([("node", pa.int32()), ("status", pa.string()), ("error", pa.string()), ("size", pa.int64())]))


@dataclass
class _Kernel:
    name: str
    seed: int
    params: dict


@dataclass
class _End:
    """The end of a node: ``status`` where it is known beforehand, else by the error."""

    node: int
    status: str | None = None
    error: str | None = None


def _plan(recipe: Recipe) -> Iterator[_Kernel | _End | Step | tuple[int, Patch]]:
    for i, node in enumerate(recipe.nodes):
        if not node.enabled:
            yield _End(i, "disabled")
            continue
        if isinstance(node, Patch):
            yield i, node
            continue
        steps = unrolled(Recipe([node]))
        unknown = next((s for s in steps if seeded_name(s) is None and s.id not in STEPS), None)
        if unknown is not None and not isinstance(node, Repeat):
            yield _End(i, "unavailable", f'step "{unknown.id}" is not available yet')
            continue
        for s in steps:
            if s is unknown:
                break
            name = seeded_name(s)
            yield s if name is None else _Kernel(name, s.seed, dict(s.params))
        yield _End(i, *(("unavailable", f'step "{unknown.id}" is not available yet') if unknown is not None else ()))


def run_nodes(df: DataFrame, recipe: Recipe, column: str = "bytes", seed: str | None = None, other: str | None = None) -> DataFrame:
    """``df`` with ``column`` run through the recipe, and ``nodes``: (node, status, error, size) of each of its nodes in order.

    Statuses: ok; error, with what the step says; stale, a patch made for another version; disabled; unavailable, a step
    that isn't known. ``size`` is that of the payload after the node, null where it was off. Null payloads stay null and
    have null for their nodes.
    """
    df = df.withColumn("nodes", F.lit(None).cast(RESULT)).withColumn("_error", F.lit(None).cast("string"))
    df = df.withColumn("nodes", F.when(F.col(column).isNotNull(), F.array().cast(RESULT)))
    waiting: list[_Kernel | _End] = []
    for op in _plan(recipe):
        if isinstance(op, (_Kernel, _End)):
            waiting.append(op)
            continue
        df, waiting = _pass(df, waiting, column, seed, other), []
        if isinstance(op, Step):
            df = df.withColumn(column, F.when(F.col("_error").isNull(), native_step(F.col(column), op)).otherwise(F.col(column)))
        else:
            node, patch = op
            fits = has_hash(F.col(column), F.lit(patch.base))
            df = df.withColumn("_fits", fits).withColumn(column, patched(F.col(column), patch))
            df = df.withColumn("nodes", _with(F.lit(node), F.when(F.col("_fits"), "ok").otherwise("stale"), F.lit(None), F.length(column))).drop("_fits")
    return _pass(df, waiting, column, seed, other).drop("_error")


def _with(node: Column, status: Column, error: Column, size: Column) -> Column:
    entry = F.struct(node.cast("int").alias("node"), status.alias("status"), error.cast("string").alias("error"), size.cast("long").alias("size"))
    return F.concat("nodes", F.array(entry))


def _pass(df: DataFrame, ops: list[_Kernel | _End], column: str, seed: str | None, other: str | None) -> DataFrame:
    """Kernels and ends of nodes; ends alone are projections."""
    if not any(isinstance(op, _Kernel) for op in ops):
        for op in ops:
            status = F.when(F.col("_error").isNotNull(), "error").otherwise(op.status or "ok")
            error = F.coalesce("_error", F.lit(op.error))
            df = df.withColumn("nodes", _with(F.lit(op.node), status, error, F.length(column) if op.status != "disabled" else F.lit(None)))
            df = df.withColumn("_error", F.lit(None).cast("string"))
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            adds = batch.column(seed).to_pylist() if seed else [0] * batch.num_rows
            donors = batch.column(other).to_pylist() if other else [None] * batch.num_rows
            data, nodes, errors = (batch.column(c).to_pylist() for c in (column, "nodes", "_error"))
            for i, d in enumerate(data):
                if d is None:
                    continue
                for op in ops:
                    if isinstance(op, _Kernel):
                        if errors[i] is None:
                            d, errors[i] = try_step(op.name, d, Pcg32((op.seed + (adds[i] or 0)) & 0xFFFFFFFF), op.params, donors[i])
                    else:
                        status = "error" if errors[i] is not None else op.status or "ok"
                        nodes[i].append({"node": op.node, "status": status, "error": op.error if errors[i] is None else errors[i], "size": len(d) if op.status != "disabled" else None})
                        errors[i] = None
                data[i] = d
            made = {column: pa.array(data, pa.binary()), "nodes": pa.array(nodes, _RESULT), "_error": pa.array(errors, pa.string())}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def node_rows(done: DataFrame, key: str) -> DataFrame:
    """(key, node, status, error, size): a row for each node of each payload."""
    return done.select(key, F.inline("nodes"))
