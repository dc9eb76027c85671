"""Canonical timetable tables over the given tables, for Spark and as SQL text for the yard-stick engine.

stop_times: one row for each visit, with (trip_id, seq) as key; a trip may visit a station several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "embeddings")
#: Service-day base; minutes count on from it without a break at midnight.
BASE = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_times(events: DataFrame) -> DataFrame:
    """(trip_id, seq, station_id, minute, dep, event_id, event_type): user = trip, key of props = station."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    minute = F.timestamp_diff("MINUTE", F.lit(BASE).cast("timestamp_ntz"), "ts").cast("int")
    return events.select(
        F.col("user_id").alias("trip_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % 25).alias("station_id"),
        minute.alias("minute"),
        (minute + (F.col("event_id") % 3).cast("int")).alias("dep"),
        "event_id",
        "event_type",
    )


def orders_by_source(lineitem: DataFrame) -> DataFrame:
    """(source, train, n): three competing sources (return flag) that each list some trains (orders) with so many stops."""
    return lineitem.groupBy(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("train")).agg(F.count("*").alias("n"))


def points(embeddings: DataFrame) -> DataFrame:
    """(point_id, lon, lat) within the fixed box of the tile scheme."""
    e = F.col("embedding")
    return embeddings.select(F.col("vec_id").alias("point_id"), (137.25 + 18.5 * e[0].cast("double")).alias("lon"), (38.25 + 16.5 * e[1].cast("double")).alias("lat"))


SQL = {
    "st": """(SELECT user_id AS trip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
      CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 AS station_id,
      CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS INTEGER) AS minute,
      CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 60) AS INTEGER) + CAST(event_id % 3 AS INTEGER) AS dep, event_id, event_type FROM events)""",
    "src": "(SELECT l_returnflag AS source, l_orderkey AS train, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "pt": "(SELECT vec_id AS point_id, 137.25 + 18.5 * CAST(embedding[1] AS DOUBLE) AS lon, 38.25 + 16.5 * CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings)",
}


def canonical(spark: SparkSession, sf_dir: str, names: set[str]) -> dict[str, DataFrame]:
    """The named tables, canonical or given."""
    made = {
        "st": lambda: stop_times(read(spark, sf_dir, "events")),
        "src": lambda: orders_by_source(read(spark, sf_dir, "lineitem")),
        "pt": lambda: points(read(spark, sf_dir, "embeddings")),
    }
    return {n: made[n]() if n in made else read(spark, sf_dir, n) for n in names}
