"""Neighbourhood operators on dense volumes, by windows along lines of tiles after one shuffle by tile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..volume import AT, KEY, OWN, POINT, TILE, by_tile, faces, line, neighbour, own_rows


def with_faces(df: DataFrame, value: str) -> DataFrame:
    """The six face neighbours as columns zm, zp, ym, yp, xm, xp; null outside."""
    return own_rows(by_tile(df).withColumns(faces(value)))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def interior(shape: tuple[int, int, int]) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(c) > 0) & (F.col(c) < n - 1) for c, n in zip(AT, shape)])


NAMES = ("zm", "zp", "ym", "yp", "xm", "xp")


def boundary_faces(df: DataFrame, shape: tuple[int, int, int], label: str = "lab") -> DataFrame:
    """``boundary``: an interior voxel that differs from a face neighbour."""
    rows = with_faces(df, label)
    differs = _any([F.coalesce(F.col(n) != F.col(label), F.lit(False)) for n in NAMES])
    return rows.withColumn("boundary", (interior(shape) & differs).cast("int")).drop(*NAMES)


def gradient_faces(df: DataFrame, label: str = "lab") -> DataFrame:
    """``boundary``: a voxel on either side of a face between different labels."""
    rows = with_faces(df, label)
    return rows.withColumn("boundary", _any([F.coalesce(F.col(n) != F.col(label), F.lit(False)) for n in NAMES]).cast("int")).drop(*NAMES)


#: Colours of label contours, red, green and blue; a volume's labels take them in ascending order, round and round.
CONTOUR_COLOURS = (
    (255, 0, 0), (255, 255, 0), (0, 0, 255), (0, 100, 0), (0, 255, 0), (255, 165, 0), (139, 0, 0), (255, 20, 147), (255, 105, 180),
    (255, 0, 0), (139, 0, 139), (255, 0, 255), (160, 32, 240), (184, 134, 11), (255, 185, 15), (255, 215, 0), (0, 191, 255), (16, 78, 139),
    (104, 131, 139), (255, 64, 64), (165, 42, 42), (255, 127, 36), (139, 90, 43), (110, 139, 61), (0, 255, 127), (255, 127, 80), (139, 10, 80),
    (219, 112, 147), (178, 34, 34), (255, 48, 48), (205, 79, 57), (160, 32, 240), (255, 100, 0),
)


def label_contours(df: DataFrame, grey: str, label: str = "lab") -> DataFrame:
    """r, g, b of slice previews: the grey value, and the label's colour where it meets another label within the slice.

    Label 0 is background and has no contour.
    """
    numbers = df.where(F.col(label) != 0).select(*KEY, F.col(label).alias("__label")).distinct()
    numbers = numbers.withColumn("__nth", (F.row_number().over(Window.partitionBy(*KEY).orderBy("__label")) - 1) % len(CONTOUR_COLOURS))
    meets = _any([F.coalesce(neighbour(label, a, s) != F.col(label), F.lit(False)) for a in ("y", "x") for s in (-1, 1)])
    rows = own_rows(by_tile(df).withColumn("__label", F.when(meets & (F.col(label) != 0), F.col(label))))
    rows = rows.join(numbers, [*KEY, "__label"], "left")
    for i, c in enumerate("rgb"):
        colour = F.get(F.array(*(F.lit(x[i]) for x in CONTOUR_COLOURS)), F.col("__nth"))
        rows = rows.withColumn(c, F.when(F.col("__nth").isNull(), F.col(grey)).otherwise(colour).cast("int"))
    return rows.drop("__label", "__nth")


def face_gradient(df: DataFrame, value: str = "v") -> DataFrame:
    """Forward differences gz, gy, gx; 0 at the end of a line."""
    return own_rows(by_tile(df).withColumns({f"g{a}": F.coalesce(neighbour(value, a, 1) - F.col(value), F.lit(0.0)) for a in AT}))


def central_gradient(df: DataFrame, value: str) -> DataFrame:
    """Central differences inside, one-sided ones at the ends."""
    out = {}
    for a in AT:
        before, after, own = neighbour(value, a, -1), neighbour(value, a, 1), F.col(value).cast("double")
        out[f"g{a}"] = F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2)
    return own_rows(by_tile(df).withColumns(out))


def surface(df: DataFrame, label: str) -> DataFrame:
    """Voxels of a 0/1 label with a gradient there."""
    return central_gradient(df, label).where((F.col(label) > 0) & ((F.col("gz") != 0) | (F.col("gy") != 0) | (F.col("gx") != 0))).select(*POINT)


def box_mean(df: DataFrame, value: str = "v") -> DataFrame:
    """Mean over the voxels of the 3 x 3 x 3 neighbourhood inside the volume: three running sums."""
    rows = by_tile(df).withColumns({"__s": F.col(value), "__n": F.lit(1)})
    for a in AT:
        w = line(a, *TILE).rowsBetween(-1, 1)
        rows = rows.withColumns({"__s": F.sum("__s").over(w), "__n": F.sum("__n").over(w)})
    return own_rows(rows).withColumn("smooth", F.col("__s") / F.col("__n")).drop("__s", "__n")


def gaussian(df: DataFrame, value: str, sigma: float = 1.0, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian with mirrored ends: per axis one shuffle by line, and a bounded run of each line a row.

    The mirror of a position that is ``reach`` away at most is so too, or the line is shorter than that.
    """
    import math

    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    rows = df.withColumn("blur", F.col(value).cast("double"))
    for a in AT:
        ends = line(a).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({"__run": F.collect_list("blur").over(line(a).rowsBetween(-reach, reach)), "__i": F.row_number().over(line(a)) - 1, "__n": F.count("*").over(ends)})
        first = F.greatest(F.col("__i") - reach, F.lit(0))

        def at(k: int, first=first) -> Column:
            i = F.pmod(F.col("__i") + k, 2 * F.col("__n"))
            return F.element_at("__run", (F.when(i < F.col("__n"), i).otherwise(2 * F.col("__n") - 1 - i) - first + 1).cast("int"))

        rows = rows.withColumn("blur", sum((at(k) * (w / total) for k, w in zip(range(-reach, reach + 1), weights)), F.lit(0.0))).drop("__run", "__i", "__n")
    return rows


def boundary_sizes(df: DataFrame, shape: tuple[int, int, int], label: str = "lab") -> DataFrame:
    """Per label: interior boundary voxels, and those that touch another label than 0."""
    rows = with_faces(df, label).where(interior(shape) & (F.col(label) != 0))
    differs = _any([F.col(n) != F.col(label) for n in NAMES])
    touches = _any([(F.col(n) != F.col(label)) & (F.col(n) != 0) for n in NAMES])
    return rows.groupBy(*KEY, label).agg(F.count_if(differs).alias("n_boundary"), F.count_if(touches).alias("n_touching"))


def neighbour_vote(df: DataFrame, label: str = "lab") -> DataFrame:
    """Per label, votes for others: each voxel votes for its first face neighbour that differs; 0 gets no vote."""
    rows = with_faces(df, label).where(F.col(label) != 0)
    first = F.coalesce(*(F.when(F.col(n) != F.col(label), F.col(n)) for n in NAMES))
    return rows.withColumn("vote", first).where("vote is not null and vote <> 0").groupBy(*KEY, label, "vote").agg(F.count("*").alias("n"))


def surface_distances(df: DataFrame, label: str = "lab", shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Distances to the label's centroid of its voxels with an empty face neighbour, inside the volume only."""
    own = Window.partitionBy(*KEY, label)
    rows = with_faces(df, label).where(F.col(label) != 0).withColumns({f"c{c}": F.avg(c).over(own) for c in AT})
    rows = rows.where(_any([F.col(n) == 0 for n in NAMES]))
    if shape:
        rows = rows.where(interior(shape))
    square = sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in AT), F.lit(0.0))
    return rows.select(*POINT, label, F.sqrt(square).alias("distance"))


def box_most(df: DataFrame, value: str) -> DataFrame:
    """Per voxel ``n`` and ``high``: the number of voxels within one step, itself included, and their greatest ``value``.

    Axis by axis each voxel tells the places before and after it what it has gathered, after one shuffle by tile; so
    gaps and repeated voxels count as in a join of the voxels with themselves.
    """
    group = [*KEY, *TILE, *AT]
    rows = by_tile(df.select(*POINT, F.col(value).alias("high"))).groupBy(*group).agg(F.count("*").alias("n"), F.max("high").alias("high"), F.count_if(OWN).alias("__mine"))
    for c in AT:
        rows = rows.withColumn("__d", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(c, F.col(c) + F.col("__d"))
        rows = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.max("high").alias("high"), F.sum(F.when(F.col("__d") == 0, F.col("__mine")).otherwise(0)).alias("__mine"))
    return rows.where("__mine > 0").select(*POINT, (F.col("n") * F.col("__mine")).alias("n"), "high")


def absorb_embedded(df: DataFrame, shape: tuple[int, int, int], share: float = 0.5, label: str = "lab") -> DataFrame:
    """(label, new_label): labels more than ``share`` of whose boundary touches others join the one with most votes."""
    inside = boundary_sizes(df, shape, label).where(F.col("n_touching") > share * F.col("n_boundary"))
    best = neighbour_vote(df, label).groupBy(*KEY, label).agg(F.max_by("vote", F.struct(F.col("n"), -F.col("vote"))).alias("new_label"))
    return inside.join(best, [*KEY, label]).select(*KEY, label, "new_label")
