"""Label selection, slices, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..volume import AT, KEY, line


def parse_labels(text: str | None) -> list[int] | None:
    """``all`` gives None, ``none`` an empty list, else the comma list; anything that is no number raises."""
    text = (text or "none").strip()
    if text.lower() == "all":
        return None
    if text.lower() == "none":
        return []
    return [int(x) for x in text.split(",") if x.strip()]


def only_labels(df: DataFrame, labels: str, label: str = "lab") -> DataFrame:
    chosen = parse_labels(labels)
    return df if chosen is None else df.withColumn(label, F.when(F.col(label).isin(chosen), F.col(label)).otherwise(0))


def ignore_labels(df: DataFrame, labels: str, label: str = "lab") -> DataFrame:
    chosen = parse_labels(labels)
    return df.withColumn(label, F.lit(0)) if chosen is None else df.withColumn(label, F.when(F.col(label).isin(chosen), 0).otherwise(F.col(label)))


def labelled_slices(df: DataFrame, label: str = "lab", axis: str = "z") -> DataFrame:
    """The numbers of the slices that hold a label."""
    return df.where(F.col(label) != 0).select(*KEY, axis).distinct()


def labelled_slices_sampled(df: DataFrame, label: str = "lab", jump: int = 5) -> DataFrame:
    """Labelled slices, each taken one moving on by ``jump``; greedy over the sorted numbers of a volume."""
    found = labelled_slices(df, label).groupBy(*KEY).agg(F.sort_array(F.collect_list("z")).alias("all"))
    greedy = F.aggregate("all", F.expr("cast(array() as array<int>)"), lambda s, k: F.when((F.size(s) == 0) | (k >= F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + jump), F.array_append(s, k)).otherwise(s))
    return found.select(*KEY, F.explode(greedy).alias("z"))


def labelled_slices_allaxis(df: DataFrame, label: str = "lab") -> DataFrame:
    """Slices that hold more than traces of slices drawn in another direction.

    In a slice first voxels that differ from both y neighbours go, then those that differ from both x
    neighbours; the slice counts if anything is left.
    """
    left = df
    for axis in ("y", "x"):
        own, before, after = F.col(label), F.coalesce(F.lag(label).over(line(axis)), F.lit(0)), F.coalesce(F.lead(label).over(line(axis)), F.lit(0))
        left = left.withColumn(label, F.when((own != before) & (own != after), 0).otherwise(own))
    return labelled_slices(left, label)


def adjacent_slices(df: DataFrame, label: str = "lab", axis: str = "z") -> DataFrame:
    """Labelled slices whose predecessor is labelled too."""
    slices = labelled_slices(df, label, axis)
    return slices.withColumn("before", F.lag(axis).over(Window.partitionBy(*KEY).orderBy(axis))).where(F.col("before") == F.col(axis) - 1).select(*KEY, axis)


def patch_origins(shape: tuple[int, int, int], size: int, stride: int) -> list[Column]:
    return [F.sequence(F.lit(0), F.lit(n - size), F.lit(stride)) for n in shape]


def patch_grid(df: DataFrame, shape: tuple[int, int, int], size: int, stride: int) -> DataFrame:
    """patch corners of every volume: pz, py, px and patch_id, the corner's linear number."""
    out = df.select(*KEY).distinct()
    for c, o in zip(AT, patch_origins(shape, size, stride)):
        out = out.withColumn(f"p{c}", F.explode(o))
    return out.withColumn("patch_id", (F.col("pz") * shape[1] + F.col("py")) * shape[2] + F.col("px"))


def patches(df: DataFrame, shape: tuple[int, int, int], size: int, stride: int) -> DataFrame:
    """Each voxel with the patches that hold it; an explosion by arithmetic, without a join."""
    out = df
    for c, n in zip(AT, shape):
        low = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride))
        high = F.least(F.floor(F.col(c) / stride), F.lit((n - size) // stride))
        out = out.where(low <= high).withColumn(f"p{c}", F.explode(F.sequence(low, high))).withColumn(f"p{c}", (F.col(f"p{c}") * stride).cast("int"))
    return out.withColumn("patch_id", (F.col("pz") * shape[1] + F.col("py")) * shape[2] + F.col("px"))


def patch_stats(df: DataFrame, shape: tuple[int, int, int], size: int, stride: int, label: str = "lab") -> DataFrame:
    """Per patch: least and largest label, the centre's label, labelled voxels and padding."""
    half = size // 2
    centre = F.lit(True)
    for c in AT:
        centre = centre & (F.col(c) == F.col(f"p{c}") + half)
    rows = patches(df, shape, size, stride)
    return rows.groupBy(*KEY, "patch_id").agg(
        F.min(label).alias("low"), F.max(label).alias("high"), F.max(F.when(centre, F.col(label))).alias("centre"),
        F.count_if(F.col(label) > 0).alias("n_labelled"), F.count_if(F.col(label) < 0).alias("n_padding"),
        F.count_distinct(F.when(F.col(label) > 0, F.col(label))).alias("n_labels"),
    )


def select_separation(stats: DataFrame) -> DataFrame:
    """Centre labelled and another label in the patch."""
    return stats.where("centre > 0 and (low <> centre or high <> centre)")


def select_refinement(stats: DataFrame) -> DataFrame:
    """Any voxel differs from the centre."""
    return stats.where("low <> centre or high <> centre")


def select_mask(stats: DataFrame) -> DataFrame:
    return stats.where("n_labelled > 0")


def drop_padding(stats: DataFrame) -> DataFrame:
    return stats.where("n_padding = 0")


def split_foreground(stats: DataFrame, rule: str = "any") -> DataFrame:
    """``foreground``: for separation a second object in the patch, else any label."""
    test = {"separation": "centre > 0 and n_labels > 1", "any": "n_labelled > 0"}[rule]
    return stats.withColumn("foreground", F.expr(test))


def crop_vector(df: DataFrame, label: str = "lab") -> DataFrame:
    """Per axis (1 z, 2 y, 3 x) and slice: +axis where the slice holds a label, else -axis."""
    parts = [df.groupBy(*KEY, F.col(a).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("hit")).select(*KEY, F.lit(i + 1).alias("axis"), "k", F.when(F.col("hit") > 0, i + 1).otherwise(-i - 1).alias("mark")) for i, a in enumerate(AT)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def clear_short_runs(df: DataFrame, key: list[str], order: str, flag: str, least: int = 8) -> DataFrame:
    """Runs of positive slices shorter than ``least`` are cleared (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(order)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*key, flag).orderBy(order))
    runs = df.withColumn("__run", island)
    n = F.count("*").over(Window.partitionBy(*key, flag, "__run"))
    return runs.withColumn(flag, F.when((F.col(flag) > 0) & (n < least), 0).otherwise(F.col(flag))).drop("__run").withColumn("nth", F.row_number().over(w))


def crop_extent(df: DataFrame, key: list[str], order: str, flag: str, margin: int, size: int) -> DataFrame:
    """First and last positive slice, widened by ``margin`` inside 0..size - 1."""
    hit = F.when(F.col(flag) > 0, F.col(order))
    return df.groupBy(*key).agg(F.greatest(F.lit(0), F.min(hit) - margin).alias("first"), F.least(F.lit(size - 1), F.max(hit) + margin).alias("last"))


def balance(df: DataFrame, flag: str, key: str) -> DataFrame:
    """The smaller class repeated to the size of the larger: whole rounds, then the first by hash.

    Ranks come from the hash alone, so no class is gathered in one task.
    """
    n = df.groupBy(flag).agg(F.count("*").alias("__n"))
    most = n.agg(F.max("__n").alias("__most"))
    rows = df.join(F.broadcast(n), flag).crossJoin(F.broadcast(most))  # two rows and one row
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    copies = F.floor(F.col("__most") / F.col("__n")) + F.when(place < F.col("__most") / F.col("__n") - F.floor(F.col("__most") / F.col("__n")), 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("__n", "__most")
