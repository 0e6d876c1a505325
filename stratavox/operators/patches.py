"""Patch inference with any model function: cut, predict in batches, add overlaps, take the best label."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..volume import AT, KEY, POINT, map_rows, map_volumes
from .selection import patches


def predict(voxels: DataFrame, shape: tuple[int, int, int], size: int, stride: int, model: Callable[[np.ndarray], np.ndarray], normalize: bool = False, value: str = "v") -> DataFrame:
    """The label of largest summed probability at each voxel, the first of equals.

    ``model`` takes (n, size, size, size) and gives (n, labels, size, size, size); every patch is
    predicted, whatever the batch.  ``normalize`` scales each patch to mean 0 and deviation 1.
    """
    rows = patches(voxels, shape, size, stride)
    inner = [F.col(c) - F.col(f"p{c}") for c in AT]
    cells = F.sort_array(F.collect_list(F.struct(*(i.alias(c) for i, c in zip(inner, AT)), F.col(value).alias("v"))))
    cubes = rows.groupBy(*KEY, *(f"p{c}" for c in AT)).agg(F.transform(cells, lambda c: c["v"]).alias("cube"))

    def run(batch: pa.RecordBatch) -> dict:
        x = np.stack([np.asarray(c, float) for c in batch.column("cube").to_pylist()]).reshape(-1, size, size, size)
        if normalize:
            x = (x - x.mean((1, 2, 3), keepdims=True)) / np.maximum(x.std((1, 2, 3), keepdims=True), 1e-6)
        p = np.asarray(model(x))
        n, labels = p.shape[:2]
        grid = np.indices((size,) * 3).reshape(3, -1)
        out = {"vec_id": np.repeat(batch.column("vec_id").to_numpy(), labels * size**3)}
        for axis, c in enumerate(AT):
            corner = batch.column(f"p{c}").to_numpy()
            out[c] = (corner[:, None, None] + grid[axis][None, None]).repeat(labels, 1).ravel().astype(np.int32)
        out["label"] = np.tile(np.repeat(np.arange(labels, dtype=np.int32), size**3), n)
        out["p"] = p.reshape(n, labels, -1).ravel()
        return out

    found = map_rows(cubes, "vec_id bigint, z int, y int, x int, label int, p double", run, rows=128)
    total = found.groupBy(*POINT, "label").agg(F.sum("p").alias("p"))
    return total.groupBy(*POINT).agg(F.max_by("label", F.struct("p", -F.col("label"))).alias("label"))


def augment_rotation(patches: DataFrame, alpha: float, beta: float = 0.0, gamma: float = 0.0, column: str = "data", labels: bool = False) -> DataFrame:
    """Training patches, blocks of one patch each, turned by angles in radians about z, y and x; ``labels`` take the nearest voxel."""
    matrix = arrays.rotation(alpha, beta, gamma)
    return map_volumes(patches, lambda a: arrays.turned(a, matrix, labels), (column,), "array<double>", tuple(AT))
