"""Shared small helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression's complement (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


#: Tables written to the shared folder by new_folder.
MADE: list[str] = []
#: Tables made by bucketed.
TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only on a local master, where none is configured at all (tests), a local one is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for tables that later stages read."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def bucketed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows written once as a table, dealt by column into as many buckets as shuffles have parts, so that grouping by it needs no exchange.

    It lies in the session's warehouse, or in the shared folder where no warehouse was set: the default
    one is a folder of the driver's own.
    """
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    TABLES.append(table)
    writer = rows.write
    if spark.conf.get("spark.sql.warehouse.dir").rstrip("/").endswith(os.path.join(os.getcwd(), "spark-warehouse")):
        writer = writer.option("path", new_folder(spark, name))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).sortBy(column).saveAsTable(table)
    return spark.table(table)


def remove_intermediate(spark: SparkSession) -> None:
    """Delete the tables that this session's operators wrote for their own later stages; their results can't be computed again after that."""
    while TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {TABLES.pop()}")
    while MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed c0, c1 and so on, so that helper columns clash with none, and the new names of the given columns."""
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{names.index(c)}" for c in columns]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id) -> F.Column:
    """True for the quarter of documents that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(values: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values of about `most` bytes together; one long value stands alone."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > most:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
