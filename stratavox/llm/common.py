"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (one machine, as in tests) gets a folder of its own; any other raises, since
    executors on other machines would not see what is written there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratavox-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables that this process has stored.
_STORED: list[str] = []


def mark() -> int:
    """How many tables are stored by now, for ``release``."""
    return len(_STORED)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that operators have stored, by Spark's own file system layer; gives their number.

    Those stored before ``since`` (a ``mark()``) and the last ``keep`` stay.  To be called once results
    are written: what is not yet computed still reads them.
    """
    jvm, n = spark.sparkContext._jvm, 0
    end = len(_STORED) - keep
    gone, _STORED[since:end] = _STORED[since:end], []
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; Spark's reader opens the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; for the driver, executors get the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 512) -> DataFrame:
    """Arrow kernel: ``make()`` runs once a task and gives a function from a batch to columns of ``schema``.

    Batches are cut to ``rows`` rows so that outputs stay small whatever the reader's batch size is.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = kernel(batch.slice(at, rows))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in ((columns[f.name], f) for f in arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column | str) -> Column:
    """True for rows kept away from learning: crc32 of the id as text leaves 1 when divided by 3."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
