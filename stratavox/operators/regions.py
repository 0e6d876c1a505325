"""Components, cleaning, filling, distances, contours and walks over blocks.

One block a volume runs as one kernel call; volumes of several blocks raise there, and are settled between
blocks (``tiled``) where an edge is given.  ``components_large`` labels blocks on their own and joins
them by their touching faces, so a volume of any size needs only as much memory as a block; local
operators take a halo (``to_blocks(..., halo=...)``) as wide as they reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..volume import AT, BLOCK, KEY, map_rows, map_volumes, to_blocks, to_voxels
from . import tiled
from .graph import graph_components, written

LONGS = "array<bigint>"


#: Axes that a block must hold from end to end for a kernel on whole volumes.
WHOLE = ("z", "y", "x")


def components(blocks: DataFrame, column: str = "data", edge: int | None = None) -> DataFrame:
    """Blocks of component numbers, 1 on in raster order, of face-connected equal non-zero values.

    With ``edge``, here and below, volumes are cut into blocks of that edge and settled between them.
    """
    return tiled.components(blocks, column, edge) if edge else map_volumes(blocks, arrays.components, (column,), LONGS, WHOLE)


def clean(blocks: DataFrame, threshold: float, column: str = "data", edge: int | None = None) -> DataFrame:
    return tiled.clean(blocks, threshold, column, edge) if edge else map_volumes(blocks, lambda a: arrays.clean(a.astype(np.int64), threshold), (column,), LONGS, WHOLE)


def fill(blocks: DataFrame, threshold: float, column: str = "data", edge: int | None = None) -> DataFrame:
    return tiled.fill(blocks, threshold, column, edge) if edge else map_volumes(blocks, lambda a: arrays.fill(a.astype(np.int64), threshold), (column,), LONGS, WHOLE)


def clean_fast(blocks: DataFrame, column: str = "data", edge: int | None = None) -> DataFrame:
    return tiled.largest(blocks, column, edge) if edge else map_volumes(blocks, arrays.largest, (column,), LONGS, WHOLE)


def fill_fast(blocks: DataFrame, column: str = "data", edge: int | None = None) -> DataFrame:
    return tiled.fill_all(blocks, column, edge) if edge else map_volumes(blocks, arrays.fill_all, (column,), LONGS, WHOLE)


def at_least(blocks: DataFrame, n: int, column: str = "data", edge: int | None = None) -> DataFrame:
    return tiled.at_least(blocks, n, column, edge) if edge else map_volumes(blocks, lambda a: arrays.at_least(a.astype(np.int64), n), (column,), LONGS, WHOLE)


def cleaned_filled(blocks: DataFrame, threshold: float, column: str = "data", edge: int | None = None) -> DataFrame:
    """Cleaned labels, with filled holes added where cleaning left nothing."""
    if edge:
        return tiled.cleaned_filled(blocks, threshold, column, edge)

    def both(a: np.ndarray) -> np.ndarray:
        a = a.astype(np.int64)
        return arrays.clean(a, threshold) + (arrays.fill(a, threshold) - a)

    return map_volumes(blocks, both, (column,), LONGS, WHOLE)


def components_large(voxels: DataFrame, label: str = "lab", edge: int = 64) -> DataFrame:
    """Voxels with ``component``, dense from 1 in raster order of first voxels, for volumes of any size.

    Blocks are labelled alone; faces between blocks give links of (block, local component); the graph's
    components number the whole.
    """
    blocks = to_blocks(voxels, edge, value=label)
    local = written(map_volumes(blocks, lambda a: arrays.components(a.astype(np.int64)), ("data",), LONGS).select("*", F.xxhash64("vec_id", "z0", "y0", "x0").alias("block")), "blocks")
    parts = to_voxels(local, value="part", keep=("block",)).where("part > 0")
    parts = parts.join(voxels.select(*KEY, *AT, label), [*KEY, *AT]).withColumn("node", F.xxhash64("block", "part"))
    links = None
    for c in AT:
        low = parts.where(F.col(c) % edge == edge - 1).select(*KEY, *(F.col(k) + (1 if k == c else 0) for k in []), *[(F.col(k) + 1).alias(k) if k == c else F.col(k) for k in AT], F.col(label).alias("__l"), F.col("node").alias("a"))
        high = parts.where((F.col(c) % edge == 0) & (F.col(c) > 0)).select(*KEY, *AT, label, F.col("node").alias("b"))
        found = low.join(high, [*KEY, *AT]).where(F.col("__l") == F.col(label)).select("a", "b").distinct()
        links = found if links is None else links.unionByName(found)
    labels = graph_components(links.distinct())
    rows = parts.join(labels, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    first = rows.groupBy(*KEY, "root").agg(F.min(F.struct(*AT)).alias("first"))
    first = first.withColumn("component", F.row_number().over(Window.partitionBy(*KEY).orderBy("first")))
    return rows.join(first.select(*KEY, "root", "component"), [*KEY, "root"]).select(*KEY, *AT, label, "component")


def chamfer(blocks: DataFrame, column: str = "data", rounds: int | None = None, edge: int | None = None) -> DataFrame:
    if edge and rounds is None:
        return tiled.settle(blocks, edge, column).select(*tiled.PLACE, F.col("dist").alias("data"))
    return map_volumes(blocks, lambda a: arrays.chamfer(a, rounds), (column,), whole=WHOLE)


def geodesic(blocks: DataFrame, lam: float, image: str = "data", seeds: str = "seeds", edge: int | None = None) -> DataFrame:
    if edge:
        return tiled.settle(blocks, edge, seeds, image, lam=lam).select(*tiled.PLACE, F.col("dist").alias("data"))
    return map_volumes(blocks, lambda a, s: arrays.geodesic(a, s, lam), (image, seeds), whole=WHOLE)


def geodesic_segment(blocks: DataFrame, lam: float, image: str = "data", seeds: str = "seeds", edge: int | None = None) -> DataFrame:
    if edge:
        return tiled.settle(blocks, edge, seeds, image, lam=lam).select(*tiled.PLACE, F.col("lab").alias("data"))
    return map_volumes(blocks, lambda a, s: arrays.geodesic_segment(a, s.astype(np.int64), lam), (image, seeds), LONGS, WHOLE)


def nearest_label(blocks: DataFrame, seeds: str = "seeds", mask: str = "mask", edge: int | None = None) -> DataFrame:
    if edge:
        return tiled.settle(blocks, edge, seeds, where=mask).select(*tiled.PLACE, F.col("lab").alias("data"))
    return map_volumes(blocks, lambda s, m: arrays.nearest_label(s.astype(np.int64), m), (seeds, mask), LONGS, WHOLE)


def curvature_flow(blocks: DataFrame, steps: int, column: str = "data") -> DataFrame:
    return map_volumes(blocks, lambda a: arrays.curvature_flow(a, steps), (column,), whole=WHOLE)


def evolve(blocks: DataFrame, alpha: float = 1.0, labels: str = "labels", image: str = "data") -> DataFrame:
    return map_volumes(blocks, lambda l, a: arrays.evolve(l, a, alpha), (labels, image), LONGS, whole=WHOLE)


def smooth_masks(blocks: DataFrame, steps: int = 1, column: str = "data") -> DataFrame:
    return map_volumes(blocks, lambda a: arrays.smooth_mask(a, steps).astype(np.int64), (column,), LONGS, whole=WHOLE)


def active_contour(blocks: DataFrame, steps: int = 6, smooth: int = 1, alpha: float = 1.0, labels: str = "labels", image: str = "data") -> DataFrame:
    return map_volumes(blocks, lambda l, a: arrays.active_contour(l, a, steps, smooth, alpha), (labels, image), LONGS, whole=WHOLE)


def resize(blocks: DataFrame, shape: tuple[int, int, int], column: str = "data") -> DataFrame:
    """Whole volumes brought to ``shape``."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: batch.column(k).to_pylist() for k in ("vec_id", "z0", "y0", "x0")}
        data = [arrays.resize(np.asarray(batch.column(column)[i].values, float).reshape([batch.column(k)[i].as_py() for k in ("nz", "ny", "nx")]), shape).ravel() for i in range(batch.num_rows)]
        return {**out, **{k: [n] * batch.num_rows for k, n in zip(("nz", "ny", "nx"), shape)}, "data": data}

    return map_rows(blocks.select("vec_id", "z0", "y0", "x0", "nz", "ny", "nx", column), f"{BLOCK}, data array<double>", run)


def random_walk_hits(blocks: DataFrame, walks: int = 10, steps: int = 4000, key: int = 0, image: str = "data", labels: str = "labels", axes: tuple[int, ...] = (0,), adaptive: bool = False) -> DataFrame:
    """vec_id, z, y, x, label, h: how often walks from seeds of each label came by.

    A block with halo walks from the seeds of all its voxels that lie in its core (columns c0..c5 if
    given, else the whole block); hits of several blocks on one voxel are summed by one shuffle, which
    stands for the exchange of halos.
    """
    core = [f"c{i}" for i in range(6)]
    has_core = all(c in blocks.columns for c in core)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("vec_id", "z", "y", "x", "label", "h")}
        jobs: list[tuple] = []
        ids: list[int] = []

        def walk() -> None:
            hits = arrays.walk_together(jobs, walks, steps)
            for first in range(0, len(jobs), len(axes)):
                h, (_, _, k, _, origin, _, _) = sum(hits[first : first + len(axes)]), jobs[first]
                at = np.argwhere(h > 0)
                out["vec_id"] += [ids[first]] * len(at)
                for c, column, o in zip(AT, at.T, origin):
                    out[c] += (column + o).tolist()
                out["label"] += [k] * len(at)
                out["h"] += h[h > 0].tolist()
            jobs.clear()
            ids.clear()

        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in ("vec_id", "z0", "y0", "x0", "nz", "ny", "nx", *(core if has_core else ()))}
            shape, origin = (row["nz"], row["ny"], row["nx"]), (row["z0"], row["y0"], row["x0"])
            a, l = (np.asarray(batch.column(c)[i].values, float).reshape(shape) for c in (image, labels))
            l = l.astype(np.int64)
            chosen = np.ones(shape, bool)
            if has_core:
                chosen[:] = False
                chosen[tuple(slice(row[f"c{2 * k}"] - o, row[f"c{2 * k + 1}"] - o) for k, o in enumerate(origin))] = True
            if adaptive:
                chosen &= arrays.adaptive_seeds(l)
            for k in np.unique(l[l > 0]):
                jobs += [(a, l, int(k), key + 7919 * axis, origin, chosen, axis) for axis in axes]
                ids += [row["vec_id"]] * len(axes)
                if sum(j[0].size for j in jobs) > 1 << 18:
                    walk()
        if jobs:
            walk()
        return out

    needed = ["vec_id", "z0", "y0", "x0", "nz", "ny", "nx", image, labels, *(core if has_core else ())]
    found = map_rows(blocks.select(*needed), "vec_id bigint, z int, y int, x int, label int, h bigint", run, rows=64)
    return found.groupBy(*KEY, *AT, "label").agg(F.sum("h").alias("h"))


def smart_interpolation(blocks: DataFrame, walks: int = 10, steps: int = 4000, key: int = 0, **options) -> DataFrame:
    """The label whose walks came by most often, at each voxel that was hit."""
    from .aggregates import argmax_label

    return argmax_label(random_walk_hits(blocks, walks, steps, key, **options), "label", "h")


def rotation_search(pairs: DataFrame, coarse: float = 15.0, fine: tuple[float, ...] = (5.0, 1.0)) -> DataFrame:
    """Pairs of masks (a, b arrays of one shape n x n x n): best Dice and its angles."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("id_a", "id_b", "dice", "alpha", "beta", "gamma")}
        for i in range(batch.num_rows):
            a, b = (np.asarray(batch.column(c)[i].values) != 0 for c in ("a", "b"))
            n = round(len(a) ** (1 / 3))
            got = arrays.search_rotation(a.reshape(n, n, n), b.reshape(n, n, n), coarse, fine)
            for k, v in zip(out, (batch.column("id_a")[i].as_py(), batch.column("id_b")[i].as_py(), *map(float, got))):
                out[k].append(v)
        return out

    return map_rows(pairs.select("id_a", "id_b", "a", "b"), "id_a bigint, id_b bigint, dice double, alpha double, beta double, gamma double", run, rows=16)


def majority_votes(groups: DataFrame, votes: str = "votes", locked: str | None = None) -> DataFrame:
    """``votes`` is an array of flat masks of one cube: voxels with two votes at least, largest component."""

    def run(batch: pa.RecordBatch) -> dict:
        data = []
        for i in range(batch.num_rows):
            masks = [np.asarray(v) for v in batch.column(votes)[i].as_py()]
            n = round(len(masks[0]) ** (1 / 3))
            lock = np.asarray(batch.column(locked)[i].values).reshape(n, n, n) if locked else None
            data.append(arrays.majority([m.reshape(n, n, n) for m in masks], lock).ravel())
        return {"vec_id": batch.column("vec_id"), "data": data}

    return map_rows(groups.select("vec_id", votes, *([locked] if locked else [])), "vec_id bigint, data array<bigint>", run)


def label_particles(blocks: DataFrame, min_size: int, mask: str = "mask", boundary: str = "boundary") -> DataFrame:
    """Instances of a mask: boundary taken out, components, refilled, ranked by size, small ones left out, holes filled."""

    def particles(m: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = m != 0
        lab = arrays.nearest_label(arrays.components(m & (b == 0)), m)
        sizes = np.bincount(lab.ravel())
        ids = [k for k in range(1, len(sizes)) if sizes[k] >= min_size]
        ids.sort(key=lambda k: (-sizes[k], -k))
        out = np.zeros(m.shape, np.int64)
        for new, k in enumerate(ids, 1):
            filled = arrays.fill_all(lab == k)
            out[(filled != 0) & (out == 0)] = new
        return out

    return map_volumes(blocks, particles, (mask, boundary), LONGS, WHOLE)


def remove_container(blocks: DataFrame, column: str = "data", width: int = 10, grid: int = 15) -> DataFrame:
    """What lies outside of the best ring of each slice becomes 0."""

    def inside(a: np.ndarray) -> np.ndarray:
        out = a.copy()
        y, x = np.indices(a.shape[1:])
        for z in range(a.shape[0]):
            cy, cx, r = arrays.fit_circle(a[z], width, grid)
            out[z][np.sqrt((y - cy) ** 2 + (x - cx) ** 2) > r] = 0
        return out

    return map_volumes(blocks, inside, (column,), whole=("y", "x"))


def surface_distances(blocks: DataFrame, a: str, b: str) -> DataFrame:
    """Per volume of one block: sum of distances between both surfaces, number of surface voxels, largest squared distance.

    Distance transforms take time by the voxels, where joining the surfaces takes it by their product.
    A volume without one of the surfaces has no row.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("vec_id", "total", "n", "hausdorff2")}
        for i in range(batch.num_rows):
            shape = [batch.column(k)[i].as_py() for k in ("nz", "ny", "nx")]
            s, t = (arrays.surface_mask(np.asarray(batch.column(c)[i].values).reshape(shape)) for c in (a, b))
            if s.any() and t.any():
                d = np.concatenate([arrays.squared_distance(t)[s], arrays.squared_distance(s)[t]])
                for k, v in zip(out, (batch.column("vec_id")[i].as_py(), float(np.sqrt(d).sum()), len(d), int(d.max()))):
                    out[k].append(v)
        return out

    return map_rows(blocks.select("vec_id", "nz", "ny", "nx", a, b), "vec_id bigint, total double, n bigint, hausdorff2 int", run)
