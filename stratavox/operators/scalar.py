"""Projections: scaling, normalising, colours, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..volume import AT, KEY


def _all(*by: str):
    return Window.partitionBy(*(by or KEY))


def scale_range(df: DataFrame, top: float = 1.0, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """``scaled`` = (v - min) / (max - min) * top within each volume; null where the volume is constant."""
    w = _all(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", (F.col(value) - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(float(top)))


def to_uint8(df: DataFrame, value: str = "v") -> DataFrame:
    return scale_range(df, 255, value).withColumn("u8", F.floor("scaled").cast("int")).drop("scaled")


def zscore_match(df: DataFrame, mean: float, std: float, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """Moved to a given mean and deviation and clipped to 0..1; constant volumes give the mean."""
    w = _all(*by)
    m, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
    moved = F.coalesce((F.col(value) - m) / F.nullif(s, F.lit(0.0)), F.lit(0.0)) * std + mean
    return df.withColumn("matched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))


def patch_normalize(df: DataFrame, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """(v - mean) / max(std, 1e-6), population deviation."""
    w = _all(*by)
    return df.withColumn("norm", (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-6)))


def mean_std(df: DataFrame, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*(by or KEY)).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def luma(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = (0.2989, 0.587, 0.114)) -> Column:
    return r * weights[0] + g * weights[1] + b * weights[2]


def rgb2gray(r: Column, g: Column, b: Column) -> Column:
    """Truncated luma."""
    return luma(r, g, b).cast("int")


def most_frequent(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per volume the most frequent value, the smallest of equals."""
    by = by or tuple(KEY)
    counts = df.groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.max_by(F.col(value), F.struct(F.col("count"), -F.col(value))).alias("background"))


def drop_background(df: DataFrame, value: str = "lab") -> DataFrame:
    """The most frequent value of each volume becomes 0."""
    return df.join(most_frequent(df, value), KEY).withColumn(value, F.when(F.col(value) == F.col("background"), 0).otherwise(F.col(value))).drop("background")


def histogram(df: DataFrame, value: str, skip_first: bool = True) -> DataFrame:
    """Counts of values with their running share; the smallest value can be left out as background."""
    counts = df.groupBy(*KEY, value).agg(F.count("*").alias("n"))
    if skip_first:
        counts = counts.withColumn("__low", F.min(value).over(_all())).where(F.col(value) > F.col("__low")).drop("__low")
    run = _all().orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cum", F.sum("n").over(run)).withColumn("share", F.col("cum") / F.sum("n").over(_all()))


def histogram_quantiles(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Per volume the first values whose running share reaches ``low`` and ``high``."""
    return histogram(df, value).groupBy(*KEY).agg(F.min(F.when(F.col("share") >= low, F.col(value))).alias("q_low"), F.min(F.when(F.col("share") >= high, F.col(value))).alias("q_high"))


def contrast(df: DataFrame, value: str = "u8", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Clipped to quantiles of what is not background, then stretched to 0..255 (z-scoring first would change nothing)."""
    rows = df.join(histogram_quantiles(df, value, low, high), KEY)
    clipped = F.greatest("q_low", F.least("q_high", value)).cast("double")
    return scale_range(rows.withColumn("__c", clipped), 255, "__c").withColumn("contrast", F.floor("scaled").cast("int")).drop("__c", "scaled", "q_low", "q_high")


def binarize(value: Column, threshold: float) -> Column:
    """Below the threshold 0, else 1 where positive; values at or below 0 that pass stay."""
    return F.when(value < threshold, 0.0).when(value > 0, 1.0).otherwise(value)


def mask_apply(df: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """0 where ``mask`` (points) has the voxel."""
    hit = mask.select(*KEY, *AT).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, KEY + AT, "left").withColumn(value, F.when(F.col("__hit"), F.lit(0)).otherwise(F.col(value))).drop("__hit")


def softmax(values: Column) -> Column:
    """Max-shifted softmax of an array column."""
    e = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def scale_probabilities(df: DataFrame, value: str = "p") -> DataFrame:
    """Divided by max(1, sum over labels) at each voxel."""
    return df.withColumn(value, F.col(value) / F.greatest(F.lit(1.0), F.sum(value).over(Window.partitionBy(*KEY, *AT))))


def crop(df: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Voxels of the half-open box, moved to its corner."""
    for c, a, b in zip(AT, low, high):
        df = df.where((F.col(c) >= a) & (F.col(c) < b))
    return df.withColumns({c: F.col(c) - a for c, a in zip(AT, low)})


def embed(df: DataFrame, low: tuple[int, int, int], shape: tuple[int, int, int], value: str = "v") -> DataFrame:
    """The volume put back at ``low`` into zeros of ``shape``."""
    grid = df.select(*KEY).distinct()
    for c, n in zip(AT, shape):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = df.withColumns({c: F.col(c) + a for c, a in zip(AT, low)}).select(*KEY, *AT, value)
    return grid.join(moved, KEY + AT, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def mirror_pad(df: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """A mirrored tail on each axis, so that ``shape`` grows to ``target``."""
    for c, n, m in zip(AT, shape, target):
        if m > n:
            df = df.unionByName(df.where(F.col(c) >= 2 * n - m).withColumn(c, 2 * n - 1 - F.col(c)))
    return df


def orient(df: DataFrame, axes: tuple[str, str, str], flips: tuple[bool, bool, bool], shape: tuple[int, int, int]) -> DataFrame:
    """Axes renamed to z, y, x in the given order, and flipped ones counted from the other end."""
    size = dict(zip(AT, shape))
    return df.withColumns({new: (F.lit(size[old] - 1) - F.col(old) if flip else F.col(old)) for new, old, flip in zip(AT, axes, flips)})


def position_channel(shape: tuple[int, int, int]) -> Column:
    """Squared distance to the centre of the volume."""
    return sum(((F.col(c) - F.lit(n / 2)) ** 2 for c, n in zip(AT, shape)), F.lit(0.0))


def area_resize(df: DataFrame, factor: int, value: str = "v") -> DataFrame:
    """Means over cubes of ``factor`` voxels."""
    return df.groupBy(*KEY, *(F.floor(F.col(c) / factor).cast("int").alias(c) for c in AT)).agg(F.avg(value).alias(value))


def resize_labels(df: DataFrame, factor: int, label: str = "lab") -> DataFrame:
    """A label survives where its whole cube holds it; the largest wins, background is not written."""
    cubes = df.groupBy(*KEY, *(F.floor(F.col(c) / factor).cast("int").alias(c) for c in AT)).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return cubes.select(*KEY, *AT, F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(0).alias(label))


def zoom_nearest(df: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """Each target voxel takes the source voxel round(i (n - 1) / (m - 1)), halves to even."""
    for c, n, m in zip(AT, shape, target):
        df = df.withColumn(c, F.explode(F.expr(f"filter(sequence(0, {m - 1}), i -> cast(rint(i * {(n - 1) / max(1, m - 1)}D) as int) = {c})")))
    return df


def upscale_labels(df: DataFrame, factor: float, shape: tuple[int, int, int]) -> DataFrame:
    """Each voxel painted over its box in the finer grid, edges truncated."""
    for c, n in zip(AT, shape):
        low, high = F.floor(F.col(c) * factor).cast("int"), F.least(F.lit(n), F.floor((F.col(c) + 1) * factor).cast("int"))
        df = df.where(low < high).withColumn(c, F.explode(F.sequence(low, high - 1)))
    return df
