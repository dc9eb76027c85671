"""Rules that a dataset must keep, as one long table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.sources.adapters import SQL, read, stop_times


def _violations(rows: DataFrame, rules: dict, key: str) -> DataFrame:
    """(rule, k, pos) for each row and rule that it breaks; rows are read once."""
    broken = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("k"), F.col("at").cast("long").alias("pos"))


def stop_violations(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Rules of (train, at, sequence, station_id, arrival, departure, loop_pass); at is the place in the list.

    Sequences increase strictly and the later of a stop's times never falls, each against the last stop
    that has one. A loop pass is the count of visits so far, of known stations only.
    """
    order = Window.partitionBy("train").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = stations.select(F.col("station_id").alias("_id")).distinct().withColumn("known", F.lit(True))
    rows = stops.join(known, F.col("station_id") == F.col("_id"), "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.withColumn("time", F.greatest("arrival", "departure"))
    rows = rows.withColumns({"before_sequence": F.last("sequence", True).over(before), "before_time": F.last("time", True).over(before)})
    rows = rows.withColumn("visit", F.row_number().over(Window.partitionBy("train", "station_id", "known").orderBy("at")))
    rules = {
        "no_sequence": F.col("sequence").isNull(),
        "sequence_not_increasing": F.col("sequence") <= F.col("before_sequence"),
        "unknown_station": ~F.col("known"),
        "loop_pass": F.col("known") & ~F.col("loop_pass").eqNullSafe(F.col("visit")),
        "no_time": F.col("time").isNull(),
        "arrival_after_departure": F.col("arrival") > F.col("departure"),
        "time_goes_backwards": F.col("time") < F.col("before_time"),
    }
    return _violations(rows, rules, "train")


def train_violations(trains: DataFrame) -> DataFrame:
    """Rules of (at, number, stops): each train has a number of its own and stops; every later train of a number is one too many."""
    nth = F.row_number().over(Window.partitionBy("number").orderBy("at"))
    missing = F.coalesce(F.col("number"), F.lit("")) == ""
    rules = {"no_train_number": missing, "repeated_train_number": ~missing & (F.col("nth") > 1), "no_stops": F.coalesce(F.col("stops"), F.lit(0)) == 0}
    return _violations(trains.withColumn("nth", nth), rules, "number")


def dataset_violations(head: DataFrame, expected: dict) -> DataFrame:
    """Rules of each dataset's row (id, version, line_id, colour, trains), `at` being its place: all there, as expected."""
    rules = {
        "no_id": F.coalesce("id", F.lit("")) == "",
        "no_version": F.coalesce("version", F.lit("")) == "",
        "no_trains": F.coalesce("trains", F.lit(0)) == 0,
        "line_id": ~F.col("line_id").eqNullSafe(F.lit(expected["line_id"])),
        "line_colour": ~F.col("colour").eqNullSafe(F.lit(expected["colour"])),
        "count": ~F.col("trains").eqNullSafe(F.lit(expected["count"])),
    }
    return _violations(head if "at" in head.columns else head.withColumn("at", F.lit(0)), rules, "id")


def station_violations(stations: DataFrame, loop: DataFrame, count: int, start: int) -> DataFrame:
    """Rules of (station_id, place, en, ja, zh) and of the loop (pos, station_id): ids, places from 1 to count, names, and the loop's members and start."""
    by = lambda c: F.count("*").over(Window.partitionBy(c))
    rows = stations.withColumns({"same_id": by("station_id"), "same_place": by("place"), "at": F.col("place")})
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {"no_station_id": F.col("station_id").isNull(), "repeated_station_id": F.col("station_id").isNotNull() & (F.col("same_id") > 1), "repeated_place": F.col("same_place") > 1, "no_place": F.col("place").isNull(), **{f"no_name_{n}": blank(n) for n in ("en", "ja", "zh")}}
    spark = stations.sparkSession
    wanted = spark.range(1, count + 1).select(F.col("id").alias("place"))
    shape = lambda rule, df, k, at: df.select(F.lit(rule).alias("rule"), F.col(k).cast("string").alias("k"), F.col(at).cast("long").alias("pos"))
    gaps = shape("place_missing", wanted.join(stations, "place", "left_anti"), "place", "place")
    outside = shape("not_in_loop", stations.where("station_id is not null").join(loop, "station_id", "left_anti"), "station_id", "place")
    extra = shape("only_in_loop", loop.join(stations, "station_id", "left_anti"), "station_id", "pos")
    begin = shape("loop_start", loop.where((F.col("pos") == 1) & (F.col("station_id") != start)), "station_id", "pos")
    size = loop.agg(F.count("*").alias("n")).where(F.col("n") != count).select(F.lit("loop_size").alias("rule"), F.col("n").cast("string").alias("k"), F.lit(0).cast("long").alias("pos"))
    return reduce(DataFrame.unionByName, [_violations(rows, rules, "station_id"), gaps, outside, extra, begin, size])


def faulty_stops(visits: DataFrame) -> DataFrame:
    """Visits with faults put in by event number."""
    e = F.col("event_id")
    visit = F.row_number().over(Window.partitionBy("trip_id", "station_id").orderBy("seq"))
    return visits.select(
        F.col("trip_id").alias("train"),
        F.col("seq").alias("at"),
        F.when(e % 61 == 0, None).when(e % 97 == 0, F.col("seq") - 1).otherwise(F.col("seq")).alias("sequence"),
        F.when(e % 89 == 0, 99).otherwise(F.col("station_id")).alias("station_id"),
        F.when(e % 79 != 0, F.when(e % 73 == 0, F.col("dep") + 5).when(e % 71 == 0, F.col("minute") - 5000).when(e % 3 > 0, F.col("minute"))).alias("arrival"),
        F.when(e % 79 != 0, F.when(e % 71 == 0, F.col("dep") - 5000).otherwise(F.col("dep"))).alias("departure"),
        F.when(e % 83 == 0, 0).otherwise(visit).alias("loop_pass"),
    )


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_violations(faulty_stops(stop_times(read(spark, sf_dir, "events"))), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station_id")))


def _trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = stop_times(read(spark, sf_dir, "events"))
    number = F.when(F.col("at") % 50 == 7, None).otherwise(F.concat(F.lit("T"), (F.col("at") - F.when(F.col("at") % 31 == 5, 1).otherwise(0)).cast("string")))
    return train_violations(visits.groupBy(F.col("trip_id").alias("at")).agg(F.count_if(F.col("trip_id") % 17 > 0).alias("stops")).withColumn("number", number))


def _head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten trips are a dataset of their own; some lack a version, an id, a colour or trains."""
    at = F.floor(F.col("user_id") / 10)
    heads = read(spark, sf_dir, "events").groupBy(at.alias("at")).agg(F.count_distinct("user_id").alias("trains"))
    k = F.col("at")
    rows = heads.select("at", F.when(k % 7 == 3, "").otherwise(F.concat(F.lit("D"), k.cast("string"))).alias("id"), F.when(k % 5 > 0, "0.1.0").alias("version"), F.when(k % 4 == 2, "OTHER").otherwise("LINE").alias("line_id"), F.when(k % 3 > 0, "#80c241").alias("colour"), F.when(k % 11 == 6, 0).otherwise(F.col("trains")).alias("trains"))
    return dataset_violations(rows, {"line_id": "LINE", "colour": "#80c241", "count": 10})


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    stations = nation.select(F.when(k != 11, k - F.when(k % 12 == 5, 1).otherwise(0)).alias("station_id"), (k + F.when(k % 7 == 3, 2).otherwise(1)).alias("place"), F.col("n_name").alias("en"), F.when(k % 5 > 0, F.col("n_name")).alias("ja"), F.when(k % 6 > 0, F.col("n_name")).otherwise("").alias("zh"))
    loop = nation.where(k % 8 != 2).select((25 - k).alias("pos"), (k + F.when(k == 20, 80).otherwise(0)).alias("station_id"))
    return station_violations(stations, loop, 25, 0)


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stop_times(read(spark, sf_dir, "events"))
    return rows.groupBy((F.col("trip_id") % 10).alias("room")).agg(F.bool_and(F.col("dep") > F.col("minute")).alias("all_ready"), F.bool_or(F.col("dep") > F.col("minute") + 1).alias("any_late"), F.count("*").alias("seats"))


QUERIES = {"stop_rule_violations": _stops, "train_rule_violations": _trains, "dataset_rule_violations": _head, "station_rule_violations": _stations, "rooms_all_ready": _ready}

_F = f"""f AS (SELECT trip_id AS train, seq AS pos, CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 97 = 0 THEN seq - 1 ELSE seq END AS sequence, CASE WHEN event_id % 89 = 0 THEN 99 ELSE station_id END AS station,
  CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 73 = 0 THEN dep + 5 WHEN event_id % 71 = 0 THEN minute - 5000 WHEN event_id % 3 > 0 THEN minute END AS a,
  CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 71 = 0 THEN dep - 5000 ELSE dep END AS d,
  CASE WHEN event_id % 83 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY trip_id, station_id ORDER BY seq) END AS lp FROM {SQL['st']}),
p AS (SELECT f.*, (SELECT g.sequence FROM f g WHERE g.train = f.train AND g.pos < f.pos AND g.sequence IS NOT NULL ORDER BY g.pos DESC LIMIT 1) AS ps,
  (SELECT greatest(g.a, g.d) FROM f g WHERE g.train = f.train AND g.pos < f.pos AND coalesce(g.a, g.d) IS NOT NULL ORDER BY g.pos DESC LIMIT 1) AS pt,
  (SELECT count(*) FROM f g WHERE g.train = f.train AND g.pos <= f.pos AND g.station = f.station) AS nth FROM f)"""
ORACLE = {
    "stop_rule_violations": f"""
WITH {_F}, v AS (SELECT 'no_sequence' AS rule, train, pos FROM p WHERE sequence IS NULL UNION ALL SELECT 'sequence_not_increasing', train, pos FROM p WHERE sequence <= ps
UNION ALL SELECT 'unknown_station', train, pos FROM p WHERE station > 24 UNION ALL SELECT 'loop_pass', train, pos FROM p WHERE station <= 24 AND lp <> nth
UNION ALL SELECT 'no_time', train, pos FROM p WHERE a IS NULL AND d IS NULL UNION ALL SELECT 'arrival_after_departure', train, pos FROM p WHERE a > d
UNION ALL SELECT 'time_goes_backwards', train, pos FROM p WHERE greatest(a, d) < pt) SELECT rule, CAST(train AS VARCHAR) AS k, pos FROM v""",
    "train_rule_violations": """
WITH t AS (SELECT DISTINCT user_id AS pos, CASE WHEN user_id % 50 <> 7 THEN 'T' || (user_id - CASE WHEN user_id % 31 = 5 THEN 1 ELSE 0 END) END AS number FROM events)
SELECT 'no_train_number' AS rule, number AS k, pos FROM t WHERE number IS NULL UNION ALL SELECT 'repeated_train_number', number, pos FROM t WHERE EXISTS (SELECT 1 FROM t o WHERE o.number = t.number AND o.pos < t.pos)
UNION ALL SELECT 'no_stops', number, pos FROM t WHERE pos % 17 = 0""",
    "dataset_rule_violations": """
WITH h AS (SELECT user_id // 10 AS pos, CASE WHEN user_id // 10 % 7 = 3 THEN '' ELSE 'D' || (user_id // 10) END AS k, CASE WHEN user_id // 10 % 11 = 6 THEN 0 ELSE count(DISTINCT user_id) END AS n FROM events GROUP BY user_id // 10)
SELECT 'no_id' AS rule, k, pos FROM h WHERE k = '' UNION ALL SELECT 'no_version', k, pos FROM h WHERE pos % 5 = 0 UNION ALL SELECT 'no_trains', k, pos FROM h WHERE n = 0
UNION ALL SELECT 'line_id', k, pos FROM h WHERE pos % 4 = 2 UNION ALL SELECT 'line_colour', k, pos FROM h WHERE pos % 3 = 0 UNION ALL SELECT 'count', k, pos FROM h WHERE n <> 10""",
    "station_rule_violations": """
WITH s AS (SELECT CASE WHEN n_nationkey = 11 THEN NULL WHEN n_nationkey % 12 = 5 THEN n_nationkey - 1 ELSE n_nationkey END AS id, n_nationkey + CASE WHEN n_nationkey % 7 = 3 THEN 2 ELSE 1 END AS place, n_nationkey AS k FROM nation),
l AS (SELECT CASE WHEN n_nationkey = 20 THEN 100 ELSE n_nationkey END AS id, 25 - n_nationkey AS pos FROM nation WHERE n_nationkey % 8 <> 2),
v AS (SELECT 'no_station_id' AS rule, id, place AS pos FROM s WHERE id IS NULL UNION ALL SELECT 'repeated_station_id', id, place FROM s WHERE id IN (SELECT id FROM s WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'repeated_place', id, place FROM s WHERE place IN (SELECT place FROM s GROUP BY place HAVING count(*) > 1)
UNION ALL SELECT 'no_name_ja', id, place FROM s WHERE k % 5 = 0 UNION ALL SELECT 'no_name_zh', id, place FROM s WHERE k % 6 = 0
UNION ALL SELECT 'place_missing', i, i FROM range(1, 26) r(i) WHERE NOT EXISTS (SELECT 1 FROM s WHERE place = i)
UNION ALL SELECT 'not_in_loop', id, place FROM s WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.id = s.id) UNION ALL SELECT 'only_in_loop', id, pos FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = l.id)
UNION ALL SELECT 'loop_start', id, pos FROM l WHERE pos = 1 AND id <> 0 UNION ALL SELECT 'loop_size', count(*), 0 FROM l HAVING count(*) <> 25)
SELECT rule, CAST(id AS VARCHAR) AS k, CAST(pos AS BIGINT) AS pos FROM v""",
    "rooms_all_ready": "SELECT user_id % 10 AS room, min(event_id % 3) > 0 AS all_ready, max(event_id % 3) > 1 AS any_late, count(*) AS seats FROM events GROUP BY 1",
}
