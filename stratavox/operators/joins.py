"""Joins by voxel, by label, by size band and by nearness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..volume import AT, KEY, POINT
from .graph import written


def voxel_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, POINT, how)


def label_lookup(df: DataFrame, table: DataFrame, label: str = "lab", new: str = "new_label") -> DataFrame:
    """Labels replaced by those of ``table`` (by volume); labels not in it become 0.

    Spark broadcasts the table if its measured size allows, else shuffles both.
    """
    on = [*KEY, label] if KEY[0] in table.columns else [label]
    return df.join(table.select(*on, new), on, "left").withColumn(label, F.coalesce(new, F.lit(0))).drop(new)


def keep_labels(df: DataFrame, table: DataFrame, label: str = "lab") -> DataFrame:
    """Labels that ``table`` does not hold become 0."""
    on = [*KEY, label] if KEY[0] in table.columns else [label]
    return df.join(table.select(*on).distinct().withColumn("__in", F.lit(True)), on, "left").withColumn(label, F.when(F.col("__in"), F.col(label)).otherwise(0)).drop("__in")


def band_join(left: DataFrame, right: DataFrame, width: float = 0.1, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with (1 - width) size_a < size_b < (1 + width) size_a, both strict.

    Sizes fall into buckets of a geometric ladder; the right side goes to its bucket and the next ones,
    so the band becomes an equi-join on (``on``, bucket) with the exact test behind it.
    """
    step = math.log1p(width)
    reach = math.ceil(-math.log1p(-width) / step)
    bucket = lambda c: F.floor(F.log(F.col(c).cast("double")) / step)
    a = left.where("size_a > 0").withColumn("__band", bucket("size_a"))
    b = right.where("size_b > 0").withColumn("__band", F.explode(F.sequence(bucket("size_b") - 1, bucket("size_b") + reach)))
    exact = (F.col("size_b") > (1 - width) * F.col("size_a")) & (F.col("size_b") < (1 + width) * F.col("size_a"))
    return a.join(b, [*on, "__band"]).where(exact).drop("__band")


def argmin_join(pairs: DataFrame, by: list[str], cost: str, order: str) -> DataFrame:
    """Per left row the candidate of least cost, the first by ``order`` of equals; aggregated before any shuffle."""
    rest = [c for c in pairs.columns if c not in (*by, cost, order)]
    best = F.min(F.struct(cost, order, *rest)).alias("best")
    return pairs.groupBy(*by).agg(best).select(*by, "best.*")


def nearest(a: DataFrame, b: DataFrame, payload: str | None = None, edge: int = 8) -> DataFrame:
    """Per voxel of ``a``: ``d2``, the squared distance to the nearest of ``b`` in its volume, and the least ``payload`` at that distance.

    Voxels meet by cells of ``edge`` and the cells around; a distance that is not above ``edge`` is final, the
    other voxels go on with cells of twice the edge, until cells are as wide as the volumes.  Cells that lie outside
    of all volumes are left out.  Spark takes the copies of a voxel for few rows, so the sides are merged and never broadcast.
    """
    ends = a.select(*AT).unionByName(b.select(*AT)).agg(F.max(F.greatest(*AT)).alias("high"), F.min(F.least(*AT)).alias("low")).first()
    if ends.high is None:
        return a.select(*POINT).limit(0).join(b.select(*KEY, F.lit(0).alias("d2"), *([payload] if payload else [])), KEY)
    todo, found = a.select(*POINT), None
    other = b.select(*KEY, *(F.col(c).alias(f"o{c}") for c in AT), *([payload] if payload else []))
    square = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in AT), F.lit(0)).cast("int")
    cells = [f"__{c}" for c in AT]
    while True:
        near, around = todo.withColumns({n: F.floor(F.col(c) / edge) for n, c in zip(cells, AT)}), other
        for n, c in zip(cells, AT):
            own = F.floor(F.col(f"o{c}") / edge)
            around = around.withColumn(n, F.explode(F.sequence(F.greatest(own - 1, F.lit(math.floor(ends.low / edge))), F.least(own + 1, F.lit(math.floor(ends.high / edge))))))
        last = edge > ends.high - ends.low
        met = near.join(around.hint("merge"), [*KEY, *cells], "inner" if last else "left")
        met = met.groupBy(*KEY, *cells, *AT).agg(F.min(F.when(F.col("oz").isNotNull(), F.struct(square.alias("d2"), *([payload] if payload else [])))).alias("best"))
        best = met.select(*POINT, "best.*")
        if last:
            return best if found is None else found.unionByName(best)
        best = written(best, "near")
        final = F.coalesce(F.col("d2") <= edge * edge, F.lit(False))
        done, todo = best.where(final), best.where(~final).select(*POINT)
        found = done if found is None else found.unionByName(done)
        if todo.isEmpty():
            return found
        edge *= 2


def min_distances(a: DataFrame, b: DataFrame, edge: int = 8) -> DataFrame:
    """Per voxel of ``a`` the squared distance to the nearest of ``b`` in the same volume."""
    return nearest(a, b, None, edge)


def scan_mask(boxes: DataFrame, voxels: DataFrame, edge: int) -> DataFrame:
    """Voxels inside each label's box: boxes meet blocks of ``edge`` by number, then the exact range is tested."""
    out = boxes
    for c in AT:
        out = out.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / edge), F.floor((F.col(f"{c}1") - 1) / edge))))
    v = voxels.withColumns({f"b{c}": F.floor(F.col(c) / edge) for c in AT})
    got = out.join(v, [*KEY, *(f"b{c}" for c in AT)])
    for c in AT:
        got = got.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")))
    return got


def resume(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return todo.join(done, on, "left_anti")


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
