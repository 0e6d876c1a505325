"""Queries over the catalogue of specimens, uploads and jobs; column names are parameters of the tables' shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, columns: list[str], order: str, limit: int = 100) -> DataFrame:
    """Rows that hold the text in any column, without case; the first by ``order``."""
    like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return df.where(reduce(lambda a, b: a | b, (F.col(c).ilike(like) for c in columns))).orderBy(order).limit(limit)


def permitted(df: DataFrame, grants: DataFrame, on: list[str]) -> DataFrame:
    return df.join(grants.select(*on).distinct(), on, "left_semi")


def one_active(df: DataFrame, by: list[str], active: str, order: str) -> DataFrame:
    """Of several active rows of a group only the first stays active."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(active), order))
    return df.withColumn(active, F.when((F.col(active) > 0) & (n == 1), 1).otherwise(0))


def ready_projects(df: DataFrame, project: str, kind: str, status: str) -> DataFrame:
    """Projects of exactly two files: an idle image and a label."""
    return df.groupBy(project).agg(F.count("*").alias("n"), F.count_if((F.col(kind) == "image") & (F.col(status) == 0)).alias("images"), F.count_if(F.col(kind) == "label").alias("labels")).where("n = 2 and images = 1 and labels = 1").select(project)


def queue_for(size: Column, limit: float = 4.2e9) -> Column:
    return F.when(size > limit, "large").otherwise("small")


def stalled(df: DataFrame, status: Column, since: str, now: Column, seconds: int) -> DataFrame:
    """Jobs in a running state for longer than ``seconds``, to the microsecond."""
    return df.where(status & (now - F.col(since) > F.make_dt_interval(secs=F.lit(seconds))))


def storage(df: DataFrame, owner: str, size: Column, quota: float) -> DataFrame:
    """Bytes by owner and whether they are above the quota."""
    return df.groupBy(owner).agg(F.sum(size).alias("used")).withColumn("over", F.col("used") > F.lit(quota))


def project_numbers(df: DataFrame, owner: str, project: str) -> DataFrame:
    return df.groupBy(owner).agg(F.max(project).alias("last"))


def merge_rows(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def elapsed(seconds: Column) -> Column:
    """``1 h 2 min 3 sec`` without leading parts that are 0."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d h %d min %d sec", h, m, r)).when(m > 0, F.format_string("%d min %d sec", m, r)).otherwise(F.format_string("%d sec", r))
