"""The live room: a stream of commands becomes the state of each room's hours, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.sources.storage import new_folder

#: Game minutes of planning at the start of an hour, and the hours of a service day.
PLANNING, FIRST_HOUR, LAST_HOUR = 1, 6, 18


def states(commands: DataFrame, minutes_per_second: int = 1) -> DataFrame:
    """(room_id, hour, commands, kinds, last_ts, game_minute, phase) of each room and hour of event time.

    game_minute is how far the clock had run at the last command; phase is what the room is in at that
    time: ENDED outside the service day, PLANNING in an hour's first minute, else LIVE.
    """
    clock = ((F.unix_timestamp("last_ts") - F.unix_timestamp("window.start")) * minutes_per_second).cast("long")
    hour = F.hour("window.start")
    phase = F.when((hour < FIRST_HOUR) | (hour >= LAST_HOUR), "ENDED").when(clock < PLANNING * 60, "PLANNING").otherwise("LIVE")
    return (
        commands.withWatermark("ts", "2 hours")
        .groupBy(F.window("ts", "1 hour"), (F.col("user_id") % 10).alias("room_id"))
        .agg(F.count("*").alias("commands"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.max("ts").alias("last_ts"))
        .select("room_id", F.col("window.start").alias("hour"), "commands", "kinds", "last_ts", clock.alias("game_minute"), phase.alias("phase"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay the events as a file stream to its end. Every batch adds the states it changed; the last one of a room's hour holds."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = new_folder(spark, "rooms")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

    def keep(changed: DataFrame, batch: int) -> None:
        # a batch done again writes the same folder again
        changed.write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

    run = states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    saved = spark.read.parquet(f"{out}/data")
    names = ["commands", "kinds", "last_ts", "game_minute", "phase"]
    last = saved.groupBy("room_id", "hour").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("room_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "s.commands", "s.kinds", F.col("s.last_ts").cast("timestamp_ntz").alias("last_ts"), "s.game_minute", "s.phase")


ORACLE = """
SELECT room_id, hour, commands, kinds, last_ts, CAST(floor(epoch(last_ts - hour)) AS BIGINT) AS game_minute,
       CASE WHEN hour(hour) NOT BETWEEN 6 AND 17 THEN 'ENDED' WHEN epoch(last_ts - hour) < 60 THEN 'PLANNING' ELSE 'LIVE' END AS phase
FROM (SELECT user_id % 10 AS room_id, date_trunc('hour', ts) AS hour, count(*) AS commands, count(DISTINCT event_type) AS kinds, max(ts) AS last_ts FROM events GROUP BY 1, 2)"""
