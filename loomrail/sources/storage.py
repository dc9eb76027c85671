"""Where intermediate and final tables of the timetable part are written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; only a local master may do without the setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ranked(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """rows with a number from 1 in the given order, which must tell all rows apart. Ranges are numbered side by side and moved on by the sizes of those before."""
    shared_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_part").count()
    # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(before, "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before")


def in_blocks(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """rows with a `block`: ranges of the given order, of about `size` rows, however many partitions there are. Rows that the order doesn't tell apart stay together."""
    shared_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(max(1, -(-rows.count() // size)), *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    # a row for each range
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = dealt.groupBy("_part").count().select("_part", F.floor(before / size).alias("block"))
    return dealt.join(blocks, "_part").drop("_part")
