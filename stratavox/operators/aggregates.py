"""Counts, boxes, overlap scores and other summaries by volume and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..volume import AT, KEY
from .graph import written


def label_histogram(df: DataFrame, label: str = "lab") -> DataFrame:
    return df.groupBy(*KEY, label).agg(F.count("*").alias("n"))


def distinct_labels(df: DataFrame, label: str = "lab") -> DataFrame:
    return df.select(*KEY, label).distinct()


def bounding_boxes(df: DataFrame, shape: tuple[int, int, int], margin: int = 10, label: str | None = "lab") -> DataFrame:
    """Per label other than 0 the box widened by ``margin`` and cut to the volume; upper ends are exclusive."""
    rows = df.where(F.col(label) != 0)
    out = rows.groupBy(*KEY, label).agg(*(f(c).alias(f"{c}{i}") for c in AT for i, f in enumerate((F.min, F.max))))
    for c, n in zip(AT, shape):
        out = out.withColumns({f"{c}0": F.greatest(F.lit(0), F.col(f"{c}0") - margin), f"{c}1": F.least(F.lit(n), F.col(f"{c}1") + 1 + margin)})
    return out


def centroids(df: DataFrame, label: str = "lab") -> DataFrame:
    return df.where(F.col(label) != 0).groupBy(*KEY, label).agg(*(F.avg(c).alias(f"c{c}") for c in reversed(AT)))


def confusion_matrix(df: DataFrame, ref: str, res: str, by: list[str] = KEY) -> DataFrame:
    return df.groupBy(*by, F.col(ref).alias("ref"), F.col(res).alias("res")).agg(F.count("*").alias("n"))


def majority_match(confusion: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per reference label the result label that overlaps most, the smallest of equals."""
    return confusion.groupBy(*by, "ref").agg(F.max_by("res", F.struct(F.col("n"), -F.col("res"))).alias("match"), F.max("n").alias("overlap"))


def dice_global(df: DataFrame, ref: str = "gt", res: str = "res", by: list[str] = KEY) -> DataFrame:
    """2 |equal and labelled| / (|ref| + |res|); null where both are empty."""
    same = F.count_if((F.col(ref) == F.col(res)) & (F.col(ref) > 0))
    return df.groupBy(*by).agg(F.try_divide(2 * same, F.count_if(F.col(ref) > 0) + F.count_if(F.col(res) > 0)).alias("dice"))


def dice_per_label(confusion: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per label other than 0 of either side, from the confusion matrix alone."""
    part = lambda c: confusion.where(F.col(c) != 0).select(*by, F.col(c).alias("label"), F.when(F.col("ref") == F.col("res"), F.col("n")).otherwise(0).alias("both"), F.when(F.lit(c == "ref"), F.col("n")).otherwise(0).alias("n_ref"), F.when(F.lit(c == "res"), F.col("n")).otherwise(0).alias("n_res"))
    rows = part("ref").unionByName(part("res").withColumn("both", F.lit(0).cast("bigint")))
    out = rows.groupBy(*by, "label").agg(*(F.sum(c).alias(c) for c in ("both", "n_ref", "n_res")))
    return out.withColumn("dice", 2 * F.col("both") / (F.col("n_ref") + F.col("n_res")))


def dice_average(confusion: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Mean over the reference's labels."""
    return dice_per_label(confusion, by).where("n_ref > 0").groupBy(*by).agg(F.avg("dice").alias("dice"))


def dice_pair(confusion: DataFrame, ref: int, res: int, by: list[str] = KEY) -> DataFrame:
    """Dice of one reference and one result label; 1 where both are empty."""
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    both, total = n((F.col("ref") == ref) & (F.col("res") == res)), n(F.col("ref") == ref) + n(F.col("res") == res)
    return confusion.groupBy(*by).agg(F.coalesce(F.try_divide(2 * both, total), F.lit(1.0)).alias("dice"))


def dice_weighted(confusion: DataFrame, bad: float = 0.8, by: list[str] = KEY) -> DataFrame:
    """Size-weighted and plain mean over the reference's labels and how many are below ``bad``."""
    rows = dice_per_label(confusion, by).where("n_ref > 0")
    return rows.groupBy(*by).agg((F.sum(F.col("n_ref") * F.col("dice")) / F.sum("n_ref")).alias("weighted"), F.avg("dice").alias("plain"), F.count_if(F.col("dice") < bad).alias("n_bad"))


def accuracy(df: DataFrame, ref: str, res: str, mask: Column | None = None, by: list[str] = KEY) -> DataFrame:
    rows = df if mask is None else df.where(mask)
    return rows.groupBy(*by).agg(F.avg((F.col(ref) == F.col(res)).cast("double")).alias("accuracy"))


def crossentropy(df: DataFrame, truth: Column, by: list[str] = KEY, least: float = 1e-7) -> DataFrame:
    """Mean of -ln of the true label's probability, clipped."""
    return df.groupBy(*by).agg(F.avg(-F.log(F.greatest(F.lit(least), F.least(F.lit(1 - least), truth)))).alias("crossentropy"))


def soft_dice_loss(df: DataFrame, truth: str, p: str, label: str, by: list[str] = KEY, smooth: float = 1e-6) -> DataFrame:
    """1 - mean over labels of the soft Dice of probabilities."""
    per = df.groupBy(*by, label).agg(((2 * F.sum(F.col(truth) * F.col(p)) + smooth) / (F.sum(truth) + F.sum(p) + smooth)).alias("soft"))
    return per.groupBy(*by).agg((1 - F.avg("soft")).alias("loss"))


def region_mean(df: DataFrame, label: str = "lab", value: str = "v") -> DataFrame:
    return df.groupBy(*KEY, label).agg(F.avg(value).alias("mean"))


def slice_region_stats(df: DataFrame, label: str, near: Column, value: str = "v") -> DataFrame:
    """Per slice and label: mean and deviation (1 at least), inside and outside of the near band."""
    return df.groupBy(*KEY, "z", label).agg(*(f.alias(f"{name}_{side}") for side, test in (("near", near), ("far", ~near)) for name, f in (("mean", F.avg(F.when(test, F.col(value)))), ("std", F.greatest(F.stddev_pop(F.when(test, F.col(value))), F.lit(1.0))))))


def top_hits(df: DataFrame, hits: str = "h", k: int = 3) -> DataFrame:
    """The k largest hit counts of each voxel, missing ones 0."""
    best = F.slice(F.sort_array(F.collect_list(hits), asc=False), 1, k)
    rows = df.groupBy(*KEY, *AT).agg(best.alias("top"))
    return rows.select(*KEY, *AT, *(F.coalesce(F.try_element_at("top", F.lit(i + 1)), F.lit(0)).alias(f"h{i + 1}") for i in range(k)))


def argmax_label(df: DataFrame, label: str = "lab", hits: str = "h") -> DataFrame:
    """The label with most hits, the smallest of equals; 0 where nothing was hit."""
    return df.groupBy(*KEY, *AT).agg(F.when(F.max(hits) > 0, F.max_by(F.col(label), F.struct(F.col(hits), -F.col(label)))).otherwise(0).alias(label))


def uncertainty(df: DataFrame) -> DataFrame:
    """(1 - (1 - h3/h1)(1 - h2/h1)) * 255 of the top three hits, truncated."""
    top = F.when(F.col("h1") == 0, 1).otherwise(F.col("h1")).cast("double")
    return df.withColumn("uncertainty", F.floor((1 - (1 - F.col("h3") / top) * (1 - F.col("h2") / top)) * 255).cast("int"))


def rank_by_size(df: DataFrame, label: str = "lab") -> DataFrame:
    """New ids 1, 2, ... by falling size, the larger label first of equals; background is left out."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), F.desc(label))
    return label_histogram(df, label).where(F.col(label) != 0).withColumn("new_label", F.row_number().over(w))


def dense_relabel(df: DataFrame, label: str = "lab") -> DataFrame:
    """Distinct labels in order to 0..n-1."""
    return distinct_labels(df, label).withColumn("new_label", F.dense_rank().over(Window.partitionBy(*KEY).orderBy(label)) - 1)


def variation(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population deviation, least, largest and relative range of positive values."""
    rows = df.where(F.col(value) > 0)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), ((F.max(value) - F.min(value)) / F.max(value)).alias("range"))


def asymmetry(df: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """Paired t statistic of the differences, its degrees of freedom, and how often left is larger."""
    d = F.col(left) - F.col(right)
    return df.groupBy(*by).agg(F.try_divide(F.avg(d) * F.sqrt(F.count(d)), F.stddev_samp(d)).alias("t"), (F.count(d) - 1).alias("dof"), F.count_if(d > 0).alias("n_left"))


def t_probability(t: float, dof: int) -> float:
    """Two-sided probability of Student's t, by the continued fraction of the incomplete beta function."""
    import math

    if dof <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(1 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``name``: the place of each row in the whole table, from 1; ``order`` should tell all rows apart.

    Rows are sorted by ranges; a part's places begin behind the rows of the parts before it, of which there are no
    more numbers than parts.
    """
    local = df.withColumns({f"__k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    keys = [f"__k{i}" for i in range(len(order))]
    local = local.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = written(local.withColumn("__id", F.monotonically_increasing_id()).drop(*keys), "ranked")
    part = F.shiftright("__id", 33)
    sizes = local.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return local.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, place.cast("int")).drop("__part", "__id", "__before")


def early_stopping(df: DataFrame, value: str, order: str, patience: int) -> DataFrame:
    """``stop``: the best value so far is not among the last ``patience``.

    ``df`` is the history of one run, a row an epoch; such a history fits one task.
    """
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.orderBy(order).rowsBetween(-patience + 1, 0)
    return df.withColumn("stop", (F.max(value).over(upto) > F.max(value).over(last)))
