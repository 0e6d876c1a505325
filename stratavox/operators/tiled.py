"""Region operators on volumes cut into blocks: components and distances are settled between blocks.

Blocks are aligned: each begins at multiples of ``edge``.  Components are made in each block alone; equal
labels on the faces between blocks link them, and a graph of these links numbers the whole.  Distances are
relaxed in each block, whose shell then goes to its neighbours, until nothing changes.  No task holds more
than some blocks and their shells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..volume import AT, BLOCK, map_rows
from .graph import graph_components, written

GRID = ["vec_id", "z0", "y0", "x0"]
SIZES = ["nz", "ny", "nx"]
PLACE = [*GRID, *SIZES]


def _shape(batch: pa.RecordBatch, i: int) -> tuple[int, ...]:
    return tuple(batch.column(k)[i].as_py() for k in SIZES)


def _array(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return np.asarray(batch.column(column)[i].values, float).reshape(_shape(batch, i))


def _alike(batch: pa.RecordBatch, columns: list[str], voxels: int = 1 << 16) -> Iterator[np.ndarray]:
    """Numbers of the rows that agree in ``columns``, about ``voxels`` of them at a time: kernels take these at once."""
    kinds, which = np.unique(np.stack([batch.column(k).to_numpy() for k in (*SIZES, *columns)], 1), axis=0, return_inverse=True)
    for k, kind in enumerate(kinds):
        at, many = np.flatnonzero(which.ravel() == k), max(1, voxels // int(np.prod(kind[:3] + 2)))
        yield from (at[i : i + many] for i in range(0, len(at), many))


def _stack(lists: pa.ListArray, at: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The lists of some rows as one array (row, z, y, x)."""
    n, offsets = int(np.prod(shape)), lists.offsets.to_numpy()
    if (offsets[at + 1] - offsets[at] != n).any():
        raise ValueError("blocks of a volume do not meet: they must tile it")
    return lists.values.to_numpy(zero_copy_only=False)[offsets[at][:, None] + np.arange(n)].astype(float).reshape(-1, *shape)


def _lists(parts: list[np.ndarray], kind: type = float) -> pa.ListArray:
    """A list for each row of each array."""
    lengths = np.concatenate([np.zeros(1, int), *(np.full(len(p), p[0].size if len(p) else 0) for p in parts)])
    values = np.concatenate([np.empty(0, kind), *(p.ravel().astype(kind) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(values))


def cut(blocks: DataFrame, edge: int, columns: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Blocks cut along multiples of ``edge``, all with the ``numbers`` (int) of their row; blocks that are small enough stay, nothing is shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        rows, boxes, parts = [np.empty(0, int)], [np.empty((0, 6), int)], {c: [] for c in columns}
        for at in _alike(batch, GRID[1:]):
            origin, shape = [batch.column(k)[int(at[0])].as_py() for k in GRID[1:]], _shape(batch, int(at[0]))
            data = {c: _stack(batch.column(c), at, shape) for c in columns}
            spans = [[(max(o, k * edge), min(o + n, (k + 1) * edge)) for k in range(o // edge, -(-(o + n) // edge))] for o, n in zip(origin, shape)]
            for box in product(*spans):
                part = (slice(None), *(slice(a - o, b - o) for (a, b), o in zip(box, origin)))
                rows.append(at)
                boxes.append(np.tile([*(a for a, _ in box), *(b - a for a, b in box)], (len(at), 1)))
                for c in columns:
                    parts[c].append(data[c][part])
        places = np.concatenate(boxes).astype(np.int32)
        taken = pa.array(np.concatenate(rows))
        return {**{c: batch.column(c).take(taken) for c in ("vec_id", *numbers)}, **dict(zip(PLACE[1:], places.T)), **{c: _lists(parts[c]) for c in columns}}

    return map_rows(blocks.select(*PLACE, *numbers, *columns), BLOCK + "".join(f", {c} int" for c in numbers) + "".join(f", {c} array<double>" for c in columns), run, rows=32)


def _node(part: str | Column, prefix: str = "") -> Column:
    return F.xxhash64(*(F.col(f"{prefix}{k}") for k in GRID), part)


FACE = "array<struct<axis: int, label: array<bigint>, part: array<bigint>>>"
TABLE = "array<struct<part: bigint, label: bigint, size: bigint, z: int, y: int, x: int, border: boolean>>"


def _local(blocks: DataFrame, column: str) -> DataFrame:
    """Blocks with local components, a table of them and the labels on the faces towards other blocks; written."""
    ends = blocks.groupBy("vec_id").agg(*(F.min(f"{c}0").alias(f"l{c}") for c in AT), *(F.max(F.col(f"{c}0") + F.col(f"n{c}")).alias(f"h{c}") for c in AT))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("data", "part", "table", "low", "high")}
        for i in range(batch.num_rows):
            a = _array(batch, column, i).astype(np.int64)
            comp = arrays.components(a)
            origin = [batch.column(k)[i].as_py() for k in GRID[1:]]
            ids, first, size = np.unique(comp, return_index=True, return_counts=True)
            outer: set[int] = set()
            faces: dict[str, list] = {"low": [], "high": []}
            for axis, c in enumerate(AT):
                for side, at in (("low", 0), ("high", -1)):
                    face = [np.take(x, at, axis).ravel() for x in (a, comp)]
                    if origin[axis] + (0 if at == 0 else a.shape[axis]) == batch.column(f"{side[0]}{c}")[i].as_py():
                        outer |= set(face[1].tolist())
                    else:
                        faces[side].append({"axis": axis, "label": face[0], "part": face[1]})
            rows = []
            for k, f, n in zip(ids.tolist(), first.tolist(), size.tolist()):
                if k:
                    z, y, x = (int(p) + o for p, o in zip(np.unravel_index(f, a.shape), origin))
                    rows.append({"part": k, "label": int(a.flat[f]), "size": n, "z": z, "y": y, "x": x, "border": k in outer})
            for k, v in zip(out, (a.ravel(), comp.ravel(), rows, faces["low"], faces["high"])):
                out[k].append(v)
        return {**{k: batch.column(k) for k in PLACE}, **out}

    schema = f"{BLOCK}, data array<bigint>, part array<bigint>, table {TABLE}, low {FACE}, high {FACE}"
    rows = blocks.select(*PLACE, column).join(ends, "vec_id").select(*PLACE, column, *(f"{e}{c}" for e in "lh" for c in AT))
    return written(map_rows(rows, schema, run, rows=32), "local")


def _nodes(local: DataFrame) -> DataFrame:
    """Per local component: its block, part, label, size, first voxel, border and the ``root`` it belongs to; written."""
    high = local.select(*PLACE, F.inline("high").alias("axis", "l_a", "p_a"))
    high = high.select(*(F.col(k).alias(f"a_{k}") for k in GRID), "vec_id", *((F.col(f"{c}0") + F.when(F.col("axis") == k, F.col(f"n{c}")).otherwise(0)).alias(f"{c}0") for k, c in enumerate(AT)), "axis", "l_a", "p_a")
    low = local.select(*GRID, F.inline("low").alias("axis", "l_b", "p_b"))
    pairs = F.arrays_zip("l_a", "p_a", "l_b", "p_b")
    same = F.array_distinct(F.transform(F.filter(pairs, lambda p: (p["l_a"] == p["l_b"]) & (p["l_a"] != 0)), lambda p: F.struct(p["p_a"].alias("a"), p["p_b"].alias("b"))))
    met = high.join(low, [*GRID, "axis"]).select(*GRID, *(f"a_{k}" for k in GRID), F.inline(same).alias("a", "b"))
    labels = graph_components(met.select(_node("a", "a_").alias("a"), _node("b").alias("b")).distinct())
    rows = local.select(*GRID, F.inline("table")).withColumn("node", _node("part"))
    return written(rows.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component", "node"), "nodes")


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("vec_id", "root").agg(F.max("label").alias("label"), F.sum("size").alias("size"), F.min(F.struct(*AT)).alias("first"), F.max("border").alias("border"))


def _applied(local: DataFrame, nodes: DataFrame, values: DataFrame, outside: int = 0) -> DataFrame:
    """Blocks with ``values`` (vec_id, root, value) in place of components; ``outside`` where there is none, 0 for roots left out."""
    own = nodes.join(values.where("value <> 0").select("vec_id", "root", F.col("value").cast("bigint").alias("value")), ["vec_id", "root"])
    own = own.groupBy(*GRID).agg(F.collect_list(F.struct("part", "value")).alias("values"))

    def run(batch: pa.RecordBatch) -> dict:
        data = []
        for i in range(batch.num_rows):
            part = np.asarray(batch.column("part")[i].values)
            table = np.zeros(int(part.max(initial=0)) + 1, np.int64)
            table[0] = outside
            for x in batch.column("values")[i].as_py() or ():
                table[x["part"]] = x["value"]
            data.append(table[part])
        return {**{k: batch.column(k) for k in PLACE}, "data": data}

    return map_rows(local.select(*PLACE, "part").join(own, GRID, "left"), f"{BLOCK}, data array<bigint>", run, rows=64)


def _relabelled(blocks: DataFrame, column: str, decide: Callable[[DataFrame], DataFrame], outside: int = 0) -> DataFrame:
    local = _local(blocks, column)
    nodes = _nodes(local)
    return _applied(local, nodes, decide(_roots(nodes)), outside)


def components(blocks: DataFrame, column: str, edge: int) -> DataFrame:
    """Numbers of components, 1 on in raster order of their first voxels."""
    order = Window.partitionBy("vec_id").orderBy("first")
    return _relabelled(cut(blocks, edge, (column,)), column, lambda r: r.withColumn("value", F.row_number().over(order)))


def clean(blocks: DataFrame, threshold: float, column: str, edge: int) -> DataFrame:
    most = F.max("size").over(Window.partitionBy("vec_id", "label"))
    stays = (F.col("size") > threshold * F.col("most")) | (F.lit(threshold < 1) & (F.col("size") == F.col("most")))
    return _relabelled(cut(blocks, edge, (column,)), column, lambda r: r.withColumn("most", most).withColumn("value", F.when(stays, F.col("label")).otherwise(0)))


def _mask(blocks: DataFrame, column: str, test: Callable[[Column], Column]) -> DataFrame:
    return blocks.withColumn(column, F.transform(column, lambda x: F.when(test(x), 1.0).otherwise(0.0)))


def largest(blocks: DataFrame, column: str, edge: int) -> DataFrame:
    """The largest component of a mask, the first of equals."""
    best = lambda r: r.groupBy("vec_id").agg(F.min(F.struct(-F.col("size"), "first", "root")).alias("b")).select("vec_id", F.col("b.root").alias("root"), F.lit(1).alias("value"))
    return _relabelled(_mask(cut(blocks, edge, (column,)), column, lambda x: x != 0), column, best)


def at_least(blocks: DataFrame, n: int, column: str, edge: int) -> DataFrame:
    """Components of a 0/1 mask that have ``n`` voxels at least."""
    return _relabelled(_mask(cut(blocks, edge, (column,)), column, lambda x: x != 0), column, lambda r: r.withColumn("value", (F.col("size") >= n).cast("int")))


def fill_all(blocks: DataFrame, column: str, edge: int) -> DataFrame:
    """A mask with every hole that does not reach the outside."""
    return _relabelled(_mask(cut(blocks, edge, (column,)), column, lambda x: x == 0), column, lambda r: r.withColumn("value", (~F.col("border")).cast("int")), outside=1)


def fill(blocks: DataFrame, threshold: float, column: str, edge: int) -> DataFrame:
    """Per label in rising order, holes not larger than ``threshold`` times the label take it.

    One pass a label: the labels themselves, a short list, are read by the driver.
    """
    now = written(cut(blocks, edge, (column,)).withColumnRenamed(column, "data"), "filled")
    for (k,) in now.select(F.explode(F.array_distinct("data")).alias("k")).where("k <> 0").distinct().orderBy("k").collect():
        own = now.groupBy("vec_id").agg(F.sum(F.size(F.filter("data", lambda x: x == k))).alias("own")).where("own > 0")
        small = lambda r, own=own: r.join(own, "vec_id").withColumn("value", (~F.col("border") & (F.col("size") <= threshold * F.col("own"))).cast("int"))
        holes = _relabelled(_mask(now, "data", lambda x: x != k), "data", small).select(*GRID, F.col("data").alias("hole"))
        both = now.join(holes, GRID).withColumn("data", F.zip_with("data", "hole", lambda d, h: F.when(h == 1, F.lit(float(k))).otherwise(d)))
        now = written(both.drop("hole"), "filled")
    return now.withColumn("data", F.col("data").cast("array<bigint>"))


def cleaned_filled(blocks: DataFrame, threshold: float, column: str, edge: int) -> DataFrame:
    """Cleaned labels, with filled holes added where cleaning left nothing."""
    one = lambda df, name: df.select(*PLACE, F.col("data").alias(name))
    old = cut(blocks, edge, (column,)).select(*PLACE, F.col(column).cast("array<bigint>").alias("old"))
    rows = one(clean(blocks, threshold, column, edge), "cleaned").join(one(fill(blocks, threshold, column, edge), "filled"), PLACE).join(old, PLACE)
    added = F.zip_with("filled", "old", lambda f, o: f - o)
    return rows.select(*PLACE, F.zip_with("cleaned", added, lambda c, a: c + a).alias("data"))


# distances ---------------------------------------------------------------------------------------

STEPS = [s for s in product((-1, 0, 1), repeat=3) if any(s)]
BITS = 1 << np.arange(len(STEPS), dtype=np.int32)


def _rows(edge: int) -> int:
    """Blocks of an edge that a task returns at a time."""
    return max(16, (1 << 18) // (edge + 2) ** 3)


def _side(step: tuple[int, ...], shape: tuple[int, ...] | None = None) -> tuple[slice, ...]:
    """The layer of a block's voxels towards a step; with the block's shape, the layer behind it in the padded block."""
    if shape is None:
        return tuple(slice(-1, None) if s > 0 else slice(0, 1) if s < 0 else slice(None) for s in step)
    return tuple(slice(1, -1) if s == 0 else slice(n + 1, n + 2) if s > 0 else slice(0, 1) for s, n in zip(step, shape))


def _shells(state: DataFrame, edge: int, told: tuple[str, ...]) -> DataFrame:
    """What blocks tell the blocks around them, to the steps in ``tells``: the layer of voxels next to each."""

    def run(batch: pa.RecordBatch) -> dict:
        origins, tells = np.stack([batch.column(k).to_numpy() for k in GRID[1:]], 1), batch.column("tells").to_numpy()
        rows, places, parts = [np.empty(0, int)], [np.empty((0, 6), int)], {c: [] for c in told}
        for at in _alike(batch, []):
            shape = _shape(batch, int(at[0]))
            data = {c: _stack(batch.column(c), at, shape) for c in parts}
            for step, bit in zip(STEPS, BITS):
                tell = np.flatnonzero(tells[at] & bit)
                rows.append(at[tell])
                places.append(np.concatenate([origins[at[tell]] // edge * edge + np.array(step) * edge, np.tile([-s for s in step], (len(tell), 1))], 1))
                for c in parts:
                    parts[c].append(data[c][(tell, *_side(step))])
        targets = np.concatenate(places).astype(np.int32)
        return {"vec_id": batch.column("vec_id").take(pa.array(np.concatenate(rows))), **dict(zip((*GRID[1:], "dz", "dy", "dx"), targets.T)), **{c: _lists(p, np.int64 if c == "lab" else float) for c, p in parts.items()}}

    schema = "vec_id bigint, z0 int, y0 int, x0 int, dz int, dy int, dx int" + "".join(f", {c} array<{'bigint' if c == 'lab' else 'double'}>" for c in told)
    return map_rows(state.where("tells <> 0").select(*PLACE, "tells", *told), schema, run, rows=_rows(edge))


def _tells(dist: np.ndarray, lab: np.ndarray, new: np.ndarray, image: np.ndarray | None, lam: float | None, told: bool) -> np.ndarray:
    """Bits of the steps, for padded blocks, behind which a ``new`` voxel betters what is known there; all is better than what was not told."""
    core, shape = (slice(None), *[slice(1, -1)] * 3), tuple(n - 2 for n in new.shape[1:])
    if not told:
        return sum((new[core][(slice(None), *_side(s))].any((1, 2, 3)) * b for s, b in zip(STEPS, BITS)), np.zeros(len(new), np.int32))
    better, start = np.zeros(new.shape, bool), np.where(new, dist, np.inf)
    for step in arrays.CUBE:
        d, l = arrays.shifted(start, step, np.inf), arrays.shifted(lab, step, 0)
        d += arrays.step_cost(step, lam, None if image is None else arrays.shifted(image, step, 0.0) - image)
        better |= arrays.is_better(d, l, dist, lab)
    return sum((better[(slice(None), *_side(s, shape))].any((1, 2, 3)) * b for s, b in zip(STEPS, BITS)), np.zeros(len(new), np.int32))


def settle(blocks: DataFrame, edge: int, seeds: str, image: str | None = None, where: str | None = None, lam: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Blocks with ``dist`` and ``lab`` of ``arrays.propagate`` over the whole volume; costs by ``lam`` if given, else by length.

    A round relaxes the blocks that were told something, those of one shape at once; the number of rounds is that of
    the blocks which the longest way goes through.  A block tells those of its neighbours, inside of the volume, which it
    may better by what they told it.  Shells are merged with blocks, never broadcast: Spark takes them for smaller than
    they are.  Raises if distances still change after ``max_rounds``.
    """
    ends = {f"{e}{c}": f(F.col(f"{c}0") + (F.col(f"n{c}") if e == "h" else 0)) for e, f in (("l", F.min), ("h", F.max)) for c in AT}
    ends = blocks.groupBy("vec_id").agg(*(v.alias(k) for k, v in ends.items()))
    limits = tuple(ends.columns[1:])
    rows = cut(blocks.join(ends.hint("merge"), "vec_id"), edge, tuple(dict.fromkeys(c for c in (seeds, image, where) if c)), limits)
    fixed = {k: v for k, v in {"image": image, "mask": where}.items() if v}
    told = ("dist", "lab", *(["image"] if image else []))
    state = rows.select(
        *PLACE, *limits, F.transform(seeds, lambda x: F.when(x != 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).alias("dist"), F.col(seeds).cast("array<bigint>").alias("lab"),
        *(F.col(v).alias(k) for k, v in fixed.items()),
    )

    def around(batch: pa.RecordBatch) -> np.ndarray:
        low, size, least, most = (np.stack([batch.column(k).to_numpy() for k in ks], 1) for ks in (GRID[1:], SIZES, limits[:3], limits[3:]))
        there = [np.where(np.array(s) < 0, low > least, np.where(np.array(s) > 0, low + size < most, True)).all(1) for s in STEPS]
        return (np.stack(there, 1) * BITS).sum(1, dtype=np.int32)

    def run(batch: pa.RecordBatch, first: bool = False) -> dict:
        n = batch.num_rows
        steps, owner, shells = np.empty((0, 3), int), np.empty(0, int), None
        if not first:
            shells = batch.column("shells")
            owner, shells = np.repeat(np.arange(n), shells.value_lengths().fill_null(0).to_numpy()), shells.flatten()
            steps = np.stack([shells.field(k).to_numpy(zero_copy_only=False) for k in ("dz", "dy", "dx")], 1)
        relax = np.full(n, True) if first else np.bincount(owner, minlength=n) > 0
        near = around(batch) if first else batch.column("around").to_numpy()
        order, parts, tells = [np.empty(0, int)], {"dist": [], "lab": []}, [np.empty(0, np.int32)]
        core = (slice(None), *[slice(1, -1)] * 3)
        pad = lambda a, e: np.pad(a, [(0, 0), *[(1, 1)] * 3], constant_values=e)
        for at in _alike(batch, []):
            shape = _shape(batch, int(at[0]))
            old = {k: _stack(batch.column(k), at, shape) for k in parts}
            old["lab"] = old["lab"].astype(np.int64)
            on, tell = np.flatnonzero(relax[at]), np.zeros(len(at), np.int32)
            if len(on):
                dist, lab = pad(old["dist"][on], np.inf), pad(old["lab"][on], 0)
                img = pad(_stack(batch.column("image"), at[on], shape), 0.0) if image else None
                ok = _stack(batch.column("mask"), at[on], shape) != 0 if where else np.ones((len(on), *shape), bool)
                place = np.full(n, -1)
                place[at[on]] = np.arange(len(on))
                own = place[owner] >= 0
                for step in np.unique(steps[own], axis=0).tolist():
                    some, side = np.flatnonzero(own & (steps == step).all(1)), _side(step, shape)
                    for a, k in ((dist, "dist"), (lab, "lab"), *([(img, "image")] if image else [])):
                        a[(place[owner[some]], *side)] = _stack(shells.field(k), some, tuple(1 if s else m for s, m in zip(step, shape)))
                arrays.relax_inside(dist, lab, ok, img, lam)
                new = np.zeros(dist.shape, bool)
                new[core] = lab[core] != 0 if first else (dist[core] != old["dist"][on]) | (lab[core] != old["lab"][on])
                old["dist"][on], old["lab"][on] = dist[core], lab[core]
                news = np.flatnonzero(new.any((1, 2, 3)))
                if len(news):
                    tell[on[news]] = _tells(dist[news], lab[news], new[news], img[news] if image else None, lam, not first)
            order.append(at)
            tells.append(tell)
            for k, p in parts.items():
                p.append(old[k])
        order, tells = np.concatenate(order), np.concatenate(tells)
        rows = batch.take(pa.array(order))
        return {**{k: rows.column(k) for k in (*PLACE, *fixed)}, "around": near[order], "dist": _lists(parts["dist"]), "lab": _lists(parts["lab"], np.int64), "tells": tells & near[order]}

    schema = f"{BLOCK}, around int, " + "".join(f"{k} array<double>, " for k in fixed) + "dist array<double>, lab array<bigint>, tells int"
    state = written(map_rows(state, schema, partial(run, first=True), rows=_rows(edge)), "settle")
    for n in range(max_rounds + 1):
        if state.where("tells <> 0").isEmpty():
            return state
        if n < max_rounds:
            shells = _shells(state, edge, told).groupBy(*GRID).agg(F.collect_list(F.struct("dz", "dy", "dx", *told)).alias("shells"))
            state = written(map_rows(state.drop("tells").join(shells.hint("merge"), GRID, "left"), schema, run, rows=_rows(edge)), "settle")
    raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
