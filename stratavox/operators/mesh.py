"""Surfaces of labels as triangles: the faces between a label and the rest, in physical units."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import formats
from ..volume import AT, KEY, arrow_schema
from .stencil import NAMES, with_faces


def label_ordinals(df: DataFrame, label: str = "lab") -> DataFrame:
    """1, 2, ... for the labels other than 0 in order: the attribute of their triangles."""
    return df.where(F.col(label) != 0).select(*KEY, label).distinct().withColumn("attribute", F.dense_rank().over(Window.partitionBy(*KEY).orderBy(label)))


def surface_quads(df: DataFrame, label: str = "lab") -> DataFrame:
    """One row a voxel face on the outside of its label: axis and side (-1 or 1)."""
    sides = F.array(*(F.struct(F.lit(i // 2).alias("axis"), F.lit(2 * (i % 2) - 1).alias("side"), F.coalesce(F.col(n), F.lit(0)).alias("other")) for i, n in enumerate(NAMES)))
    rows = with_faces(df, label).where(F.col(label) != 0).select(*KEY, *AT, label, F.inline(sides))
    return rows.where(F.col("other") != F.col(label)).drop("other")


def surface_area(df: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), label: str = "lab") -> DataFrame:
    """Per label the number of faces and their area; spacing is x, y, z."""
    x, y, z = spacing
    area = F.element_at(F.array(F.lit(y * x), F.lit(z * x), F.lit(z * y)), F.col("axis") + 1)
    return surface_quads(df, label).groupBy(*KEY, label).agg(F.count("*").alias("n_faces"), F.sum(area).alias("area"))


def triangles(df: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), label: str = "lab") -> DataFrame:
    """Two triangles a face, corners wound so that normals point outwards; with the label's ordinal."""
    quads = surface_quads(df, label).join(label_ordinals(df, label), [*KEY, label])
    axis = F.col("axis")
    step = lambda k, v: F.when(axis == k, F.when(F.col("side") > 0, 1).otherwise(0)).otherwise(v)

    def corner(u: int, v: int):
        # the two axes of the face, in an order that turns right-handed about the outward normal
        a = {0: (2, 1), 1: (0, 2), 2: (1, 0)}
        values = []
        for k, c in enumerate(AT):
            flat = F.lit(0)
            for own, (first, second) in a.items():
                flat = F.when((axis == own) & F.lit(k == first), u).when((axis == own) & F.lit(k == second), v).otherwise(flat)
            values.append((F.col(c) + step(k, flat)).cast("double"))
        return F.struct((values[2] * spacing[0]).alias("x"), (values[1] * spacing[1]).alias("y"), (values[0] * spacing[2]).alias("z"))

    ring = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
    forward = F.array(F.struct(ring[0].alias("p0"), ring[1].alias("p1"), ring[2].alias("p2")), F.struct(ring[0].alias("p0"), ring[2].alias("p1"), ring[3].alias("p2")))
    back = F.array(F.struct(ring[0].alias("p0"), ring[2].alias("p1"), ring[1].alias("p2")), F.struct(ring[0].alias("p0"), ring[3].alias("p1"), ring[2].alias("p2")))
    return quads.select(*KEY, label, "attribute", F.explode(F.when(F.col("side") > 0, forward).otherwise(back)).alias("t")).select(*KEY, label, "attribute", "t.*")


def stl_files(mesh: DataFrame) -> DataFrame:
    """(vec_id, content): binary STL of each volume's triangles, streamed in order of volume within a task."""
    schema = arrow_schema("vec_id bigint, content binary")
    xyz = lambda p: F.array(*(F.col(f"{p}.{c}") for c in "xyz"))
    flat = mesh.groupBy("vec_id").agg(F.collect_list(F.struct(F.concat(xyz("p0"), xyz("p1"), xyz("p2")).alias("p"), F.col("attribute").alias("a"))).alias("t"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                t = sorted((tuple(x["p"]), x["a"]) for x in r["t"])
                yield pa.RecordBatch.from_pylist([{"vec_id": r["vec_id"], "content": formats.encode_stl(np.array([x[0] for x in t]), np.array([x[1] for x in t]))}], schema=schema)

    return flat.mapInArrow(run, "vec_id bigint, content binary")
