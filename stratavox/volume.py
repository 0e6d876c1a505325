"""Two layouts of one logical table of voxels, and what converts between them.

*voxels*: one row a voxel (``vec_id, z, y, x`` and values), for relational operators.
*blocks*: one row a box of voxels (``vec_id, z0, y0, x0, nz, ny, nx, data``), for numpy kernels; a
block is at most ``edge`` voxels wide, so a kernel's memory does not grow with the volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["vec_id"]
AT = ["z", "y", "x"]
POINT = KEY + AT
BLOCK = "vec_id bigint, z0 int, y0 int, x0 int, nz int, ny int, nx int"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def embedding_blocks(spark: SparkSession, sf_dir: str, edge: int = 4) -> DataFrame:
    """``embeddings`` as one 4 x 4 x 4 block a row; no shuffle."""
    n = F.lit(edge)
    zero = F.lit(0)
    data = F.transform("embedding", lambda v: v.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *(zero.alias(c) for c in ("z0", "y0", "x0")), *(n.alias(c) for c in ("nz", "ny", "nx")), data.alias("data"))


def embedding_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, z, y, x, v of every embedding entry, with labels by threshold.

    gt = v > 0, res = v > 0.05 and lab in 0..3; the thresholds are those of the test views.
    """
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    rows = rows.select("vec_id", "label", *linear_decode(F.col("p"), F.lit(4), F.lit(4)), F.col("e").cast("double").alias("v"))
    lab = F.when(F.col("v") > 0.05, 3).when(F.col("v") > 0, 2).when(F.col("v") > -0.05, 1).otherwise(0)
    return rows.withColumns({"gt": (F.col("v") > 0).cast("int"), "res": (F.col("v") > 0.05).cast("int"), "lab": lab})


def linear_id(z: Column, y: Column, x: Column, ny: Column, nx: Column) -> Column:
    return (z * ny + y) * nx + x


def linear_decode(i: Column, ny: Column, nx: Column) -> list[Column]:
    """z, y, x of a linear number."""
    i = i.cast("bigint")
    return [F.floor(i / (ny * nx)).cast("int").alias("z"), (F.floor(i / nx) % ny).cast("int").alias("y"), (i % nx).cast("int").alias("x")]


def to_voxels(blocks: DataFrame, column: str = "data", value: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = blocks.select("vec_id", *keep, "z0", "y0", "x0", "ny", "nx", F.posexplode(column).alias("p", value))
    z, y, x = linear_decode(F.col("p"), F.col("ny"), F.col("nx"))
    return rows.select("vec_id", *keep, (z + F.col("z0")).alias("z"), (y + F.col("y0")).alias("y"), (x + F.col("x0")).alias("x"), value)


def to_blocks(voxels: DataFrame, edge: int = 64, halo: int = 0, value: str = "v", empty: float = 0.0) -> DataFrame:
    """Voxels gathered into blocks of ``edge``; with a halo each voxel goes to all blocks that it touches."""
    def origins(c: str) -> Column:
        low, high = F.floor((F.col(c) - halo) / edge), F.floor((F.col(c) + halo) / edge)
        return F.sequence(F.greatest(low, F.lit(0)), high)

    rows = voxels.select(*POINT, F.col(value).cast("double").alias("__v"))
    for c in AT:
        rows = rows.withColumn(f"{c}0", F.explode(origins(c)) if halo else F.floor(F.col(c) / edge)).withColumn(f"{c}0", (F.col(f"{c}0") * edge).cast("int"))
    groups = rows.groupBy("vec_id", "z0", "y0", "x0").agg(F.collect_list(F.struct(*AT, "__v")).alias("cells"))

    def fill(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("vec_id", "z0", "y0", "x0", "nz", "ny", "nx", "data")}
        for row in batch.to_pylist():
            cells = row.pop("cells")
            z, y, x = (np.array([c[k] for c in cells]) for k in AT)
            own = (z >= row["z0"]) & (z < row["z0"] + edge) & (y >= row["y0"]) & (y < row["y0"] + edge) & (x >= row["x0"]) & (x < row["x0"] + edge)
            if not own.any():
                continue
            low, high = (z.min(), y.min(), x.min()), (z.max() + 1, y.max() + 1, x.max() + 1)
            box = np.full([b - a for a, b in zip(low, high)], empty)
            box[z - low[0], y - low[1], x - low[2]] = [c["__v"] for c in cells]
            for k, v in zip(out, (row["vec_id"], *map(int, low), *box.shape, box.ravel())):
                out[k].append(v)
        return out

    return map_rows(groups, f"{BLOCK}, data array<double>", fill)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, schema: str, kernel: Callable[[pa.RecordBatch], dict], rows: int = 256) -> DataFrame:
    """Arrow kernel over at most ``rows`` rows at a time."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(kernel(batch.slice(at, rows)), schema=arrow)

    return df.mapInArrow(run, schema)


def map_volumes(blocks: DataFrame, kernel: Callable[..., np.ndarray], columns: tuple[str, ...] = ("data",), out: str = "array<double>", whole: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(array, ...)`` on the (nz, ny, nx) arrays of each block; its result becomes ``data``.

    ``whole`` names the axes that a block must hold from end to end; a block that begins inside of a volume raises.
    """
    def run(batch: pa.RecordBatch) -> dict:
        got = {k: batch.column(k) for k in ("vec_id", "z0", "y0", "x0", "nz", "ny", "nx")}
        if any(any(got[f"{c}0"].to_pylist()) for c in whole):
            raise ValueError("this kernel needs whole volumes, and these are cut into blocks: give the edge of the blocks")
        shapes = zip(*(got[k].to_pylist() for k in ("nz", "ny", "nx")))
        data = []
        for i, shape in enumerate(shapes):
            arrays = [np.asarray(batch.column(c)[i].values, dtype=float).reshape(shape) for c in columns]
            data.append(np.asarray(kernel(*arrays)).ravel())
        return {**got, "data": data}

    return map_rows(blocks.select("vec_id", "z0", "y0", "x0", "nz", "ny", "nx", *columns), f"{BLOCK}, data {out}", run)


#: The tile that a row is placed in by ``by_tile``, and whether it belongs to it or to its halo.
TILE = [f"__t{c}" for c in AT]
OWN = "__own"


def by_tile(voxels: DataFrame, halo: int = 1, edge: int = 64) -> DataFrame:
    """Voxels placed by tile, with the voxels around it, so that windows over lines of a tile need no further shuffle.

    A task's tiles are of bounded size however large a volume is.  ``own_rows`` drops the halo afterwards.
    """
    rows = voxels
    for c, t in zip(AT, TILE):
        rows = rows.withColumn(t, F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / edge), F.lit(0)), F.floor((F.col(c) + halo) / edge))))
    own = [F.floor(F.col(c) / edge) == F.col(t) for c, t in zip(AT, TILE)]
    return rows.withColumn(OWN, own[0] & own[1] & own[2]).repartition(*KEY, *TILE)


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(OWN)).drop(OWN, *TILE)


def line(axis: str, *tile: str) -> Window:
    """The window along one axis, of the volume or of the given tile columns."""
    return Window.partitionBy(*KEY, *tile, *(c for c in AT if c != axis)).orderBy(axis)


def neighbour(value: str | Column, axis: str, step: int) -> Column:
    """The value one voxel on along an axis, over rows of ``by_tile``; null outside; the volume must be dense."""
    col = F.col(value) if isinstance(value, str) else value
    return (F.lag(col, -step) if step < 0 else F.lead(col, step)).over(line(axis, *TILE))


def faces(value: str) -> dict[str, Column]:
    """The six face neighbours, in the order z-, z+, y-, y+, x-, x+."""
    return {f"{a}{'m' if s < 0 else 'p'}": neighbour(value, a, s) for a in AT for s in (-1, 1)}
