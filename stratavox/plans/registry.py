"""Names, queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHAPE = (4, 4, 4)

#: The voxel view of ``embeddings`` in DuckDB SQL.
VOX = """vox as (select *, (v > 0)::int as gt, (v > 0.05::double)::int as res,
  (case when v > 0.05::double then 3 when v > 0 then 2 when v > (-0.05)::double then 1 else 0 end)::int as lab
  from (select vec_id, label, (p // 16)::int as z, ((p // 4) % 4)::int as y, (p % 4)::int as x, v
    from (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as p from embeddings)))"""


def faces_sql(value: str, name: str = "fac", source: str = "vox") -> str:
    lines = {"z": "y, x", "y": "z, x", "x": "z, y"}
    cols = ", ".join(f"{f}({value}) over w{a} as {a}{s}" for a in lines for f, s in (("lag", "m"), ("lead", "p")))
    wins = ", ".join(f"w{a} as (partition by vec_id, {rest} order by {a})" for a, rest in lines.items())
    return f"{name} as (select *, {cols} from {source} window {wins})"


FAC = faces_sql("lab")
INSIDE = "(z between 1 and 2 and y between 1 and 2 and x between 1 and 2)"
DIFFERS = " or ".join(f"coalesce({c} <> lab, false)" for c in ("zm", "zp", "ym", "yp", "xm", "xp"))


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` may begin with further views after the voxel view."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def vox_sql(body: str, *views: str) -> str:
    return f"with {', '.join([VOX, *views])} {body}"


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
