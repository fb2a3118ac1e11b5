"""Recipes: ordered steps that compile to one chain of column expressions.

A recipe is JSON with a list of nodes: steps, groups of steps that repeat, and patches, which hold for payloads of one
hash. Nodes of ``{"type": "step" | "repeat" | "patch", ..}`` and the shorter ``{"id": ..}`` and ``{"repeat": n, "steps"}``
are read; what is neither is left out.
"""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.functions.batches import small
from shardmend.functions.hashes import has_hash, text_hash
from shardmend.functions.prng import Pcg32, turn_seed
from shardmend.operators import marker_steps  # noqa: F401  (adds its steps)
from shardmend.operators.byte_steps import STEPS, byte_patch
from shardmend.operators.seeded_steps import ALIASES, run_step, takes_other
from shardmend.operators.seeded_steps import STEPS as SEEDED

MOST_TURNS = 500


@dataclass
class Step:
    id: str
    params: dict = field(default_factory=dict)
    seed: int = 0
    enabled: bool = True


@dataclass
class Repeat:
    steps: list[Step]
    times: int = 1
    enabled: bool = True
    seed: int = 0


@dataclass
class Patch:
    """Bytes at offsets, for payloads whose hash is ``base``; others pass as they are."""

    base: str
    patches: list[tuple[int, bytes]]
    enabled: bool = True


@dataclass
class Recipe:
    nodes: list[Step | Repeat | Patch]
    engine: str = ""
    source: str | None = None


def seeded_name(step: Step) -> str | None:
    """The kernel that a step runs, if it isn't a column expression. A text-mode transfer of a part of the file is one."""
    name = ALIASES.get(step.id, step.id)
    if name == "ftp_ascii" and "portion" in step.params:
        return "ftp_stretch"
    return name if name in SEEDED and name not in STEPS else None


def needs_other(recipe: Recipe) -> bool:
    """Whether any step of a recipe takes another payload."""
    return any(isinstance(s, Step) and (name := seeded_name(s)) is not None and takes_other(name) for s in unrolled(recipe))


def apply_recipe(df: DataFrame, recipe: Recipe, column: str = "bytes", seed: str | None = None, other: str | None = None) -> DataFrame:
    """``df`` with ``column`` run through the recipe.

    Steps without seeds and patches become projections. Neighbouring seeded steps are fused, so that a payload goes to
    Python and back once for all of them; ``seed`` names a column that is added to their seeds, as for the payloads of a
    batch, and ``other`` one with the payload that donor steps take. Steps that fail or aren't known pass their input on.
    """
    waiting: list[tuple[str, Step]] = []
    for node in unrolled(recipe):
        if isinstance(node, Step):
            name = seeded_name(node)
            if name is not None:
                waiting.append((name, node))
                continue
            if node.id not in STEPS:
                continue
        df = _fused(df, waiting, column, seed, other)
        waiting = []
        df = df.withColumn(column, patched(F.col(column), node) if isinstance(node, Patch) else native_step(F.col(column), node))
    return _fused(df, waiting, column, seed, other)


def native_step(b: Column, step: Step) -> Column:
    names = list(inspect.signature(STEPS[step.id]).parameters)[1:]
    params = {("hexed" if k == "hex" else k): v for k, v in step.params.items()}
    return STEPS[step.id](b, **{k: v for k, v in params.items() if k in names})


def patched(b: Column, patch: Patch) -> Column:
    """A payload with the patch's bytes if its hash is the patch's base; offsets past its end are ignored."""
    out = b
    for at, data in patch.patches:
        data, at = data[max(0, -at) :], max(0, at)
        out = byte_patch(out, at, data.hex())
    return F.when(has_hash(b, F.lit(patch.base)), out).otherwise(b)


def _fused(df: DataFrame, steps: list[tuple[str, Step]], column: str, seed: str | None, other: str | None) -> DataFrame:
    if not steps:
        return df
    steps = [(name, s.seed, dict(s.params)) for name, s in steps]

    def run(batches):
        for batch in small(batches):
            adds = batch.column(seed).to_pylist() if seed else [0] * batch.num_rows
            donors = batch.column(other).to_pylist() if other else [None] * batch.num_rows
            done = []
            for data, add, donor in zip(batch.column(column).to_pylist(), adds, donors, strict=True):
                if data is not None:
                    for name, own, params in steps:
                        data = run_step(name, data, Pcg32((own + (add or 0)) & 0xFFFFFFFF), params, donor)
                done.append(data)
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(done, pa.binary()))

    return df.mapInArrow(run, df.schema)


def unrolled(recipe: Recipe) -> list[Step | Patch]:
    """Enabled nodes in order, with repeats written out; each turn of a repeat has seeds of its own."""
    out: list[Step | Patch] = []
    for node in recipe.nodes:
        if not node.enabled:
            continue
        if not isinstance(node, Repeat):
            out.append(node)
            continue
        for turn in range(node.times):
            out += [replace(s, seed=turn_seed(s.seed, node.seed, turn)) for s in node.steps if s.enabled]
    return out


def generation(recipe: Recipe, k: int) -> Recipe:
    """The recipe for the k-th time that a payload goes through it: k is added to its seeds."""
    moved = lambda n: n if isinstance(n, Patch) else replace(n, seed=(n.seed + k) & 0xFFFFFFFF)
    return replace(recipe, nodes=[replace(moved(n), steps=[moved(s) for s in n.steps]) if isinstance(n, Repeat) else moved(n) for n in recipe.nodes])


def _whole(x: object, else_: int = 0) -> int:
    try:
        return int(float(x))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return else_


def _step(x: object) -> Step | None:
    if not isinstance(x, dict) or not isinstance(x.get("id"), str) or not isinstance(x.get("params", {}), dict):
        return None
    return Step(x["id"], dict(x.get("params") or {}), _whole(x.get("seed")) & 0xFFFFFFFF, x.get("enabled") is not False)


def _node(x: object) -> Step | Repeat | Patch | None:
    if not isinstance(x, dict):
        return None
    on, seed = x.get("enabled") is not False, _whole(x.get("seed")) & 0xFFFFFFFF
    children = x.get("children") if x.get("type") == "repeat" else x.get("steps") if "repeat" in x else None
    if isinstance(children, list):
        times = x.get("times") if x.get("type") == "repeat" else x["repeat"]
        return Repeat([s for s in map(_step, children) if s is not None], min(MOST_TURNS, max(1, _whole(times))), on, seed)
    if x.get("type") == "patch" and isinstance(x.get("patches"), list):
        good = [p for p in x["patches"] if isinstance(p, dict) and isinstance(p.get("offset"), (int, float)) and isinstance(p.get("bytes"), list)]
        return Patch(str(x.get("baseHash") or ""), [(int(p["offset"]), bytes(_whole(v) & 255 for v in p["bytes"])) for p in good], on)
    return _step(x) if x.get("type", "step") == "step" else None


def parse_recipe(text: str) -> Recipe:
    """A recipe from JSON; a document that names a format must name that of a recipe."""
    found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("steps"), list) or not str(found.get("format", "-recipe")).endswith("-recipe"):
        raise ValueError("this is no recipe")
    source = found.get("source")
    return Recipe([n for n in map(_node, found["steps"]) if n is not None], str(found.get("engine") or ""), source if isinstance(source, str) else None)


def _written(node: Step | Repeat | Patch) -> dict:
    if isinstance(node, Step):
        return {"type": "step", "id": node.id, "params": node.params, "seed": node.seed, "enabled": node.enabled}
    if isinstance(node, Repeat):
        return {"type": "repeat", "times": node.times, "seed": node.seed, "enabled": node.enabled, "children": [_written(s) for s in node.steps]}
    return {"type": "patch", "enabled": node.enabled, "baseHash": node.base, "patches": [{"offset": at, "bytes": list(data)} for at, data in node.patches]}


def write_recipe(recipe: Recipe, format_: str = "shardmend-recipe") -> str:
    """A recipe as JSON that ``parse_recipe`` reads."""
    out = {"format": format_, "version": 1, "engine": recipe.engine, "steps": [_written(n) for n in recipe.nodes]}
    return json.dumps(out | ({"source": recipe.source} if recipe.source else {}), ensure_ascii=False)


def stable_json(value: object) -> str:
    """JSON without spaces and with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def signature(node: Step | Repeat | Patch) -> str:
    """What tells a node's work: equal signatures do the same."""
    if isinstance(node, Step):
        return f"S{node.id}:{node.seed}:{stable_json(node.params)}"
    if isinstance(node, Repeat):
        return f"R{node.times}:{node.seed}:" + ";".join(signature(s) for s in node.steps if s.enabled)
    return f"P{node.base}:" + stable_json([{"offset": at, "bytes": list(data)} for at, data in node.patches])


def plan_keys(recipe: Recipe, source: Column, pool: str = "") -> Column:
    """An array of keys for the results after each node of a payload whose own key is ``source``.

    Equal keys mean equal results, so that what is written for a prefix can be read again. A node that is off, and a
    repeat with nothing to do, keep the key before them; a node that takes other payloads also depends on ``pool``.
    """
    signs: list[Column] = []
    for node in recipe.nodes:
        works = node.enabled and not (isinstance(node, Repeat) and (node.times < 1 or not any(s.enabled for s in node.steps)))
        signs.append(F.lit("|" + signature(node) + (f"|pool:{pool}" if needs_other(Recipe([node])) else "") if works else None).cast("string"))
    if not signs:
        return F.array()
    # Each key is made once, of the one before it.
    last = lambda keys: F.element_at(keys, -1)
    step = lambda keys, sign: F.concat(keys, F.array(F.when(sign.isNull(), last(keys)).otherwise(text_hash(F.concat(last(keys), sign)))))
    return F.slice(F.aggregate(F.array(*signs), F.array(F.concat(F.lit("src:"), source)), step), 2, len(signs))
