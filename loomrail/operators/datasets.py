"""Train datasets of several sources: names, keys, merging, ids, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.functions import minutes_of, normal_name, romanised, seconds_of, train_label, trip_id, whole_minutes
from loomrail.sources.adapters import SQL, read, stop_times
from loomrail.sources.storage import ranked


def merge_key(trains: DataFrame) -> DataFrame:
    """trains (dataset, train, service, number, n) with the key under which sources agree: the service and its number, else the train's own."""
    service = romanised(F.col("service"))
    named = (service != "") & (F.col("number") != "")
    key = F.when(F.coalesce(named, F.lit(False)), F.concat_ws("::", F.lit("service"), service, "number")).otherwise(F.concat_ws("::", F.lit("train"), "train"))
    return trains.withColumn("merge_key", key)


def merged(trains: DataFrame) -> DataFrame:
    """One train of each key: the longest list of stops, of those the one that came first."""
    order = Window.partitionBy("merge_key").orderBy(F.desc("n"), "dataset", "train")
    sources = F.count("*").over(Window.partitionBy("merge_key"))
    return merge_key(trains).withColumn("place", F.row_number().over(order)).withColumn("sources", sources).where("place = 1").drop("place")


def merge_steps(trains: DataFrame) -> DataFrame:
    """What each later train of a key did: it took the place of a shorter list, or the list held stayed."""
    before = Window.partitionBy("merge_key").orderBy("dataset", "train").rowsBetween(Window.unboundedPreceding, -1)
    steps = merge_key(trains).withColumn("best", F.max("n").over(before)).where("best is not null")
    longer = F.col("n") > F.col("best")
    resolution = F.when(longer, "replaced_with_longer_stop_list").otherwise("kept_existing_longer_or_equal_stop_list")
    return steps.select("merge_key", "train", "dataset", resolution.alias("resolution"), F.greatest("n", "best").alias("kept_stop_count"), F.least("n", "best").alias("dropped_stop_count"))


def source_trains(lineitem: DataFrame) -> DataFrame:
    """(dataset, train, service, number, n) of the driver's rows: a dataset for each return flag, names in two scripts for one service."""
    k = F.col("l_orderkey")
    trains = lineitem.groupBy(F.col("l_returnflag").alias("dataset"), k.alias("key")).agg(F.count("*").alias("n"))
    service = F.element_at(F.array(F.lit("のぞみ"), F.lit("Nozomi"), F.lit(None), F.lit("")), (F.col("key") % 4 + 1).cast("int"))
    return trains.select("dataset", F.col("key").cast("string").alias("train"), service.alias("service"), F.floor(F.col("key") / 2).cast("string").alias("number"), "n")


def instances(orders: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """(trip_id, train, stops, suppliers): trips numbered by date and key; ids have five digits or more."""
    stops = lineitem.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey").agg(F.count("*").alias("stops"), F.countDistinct("s_nationkey").alias("suppliers"))
    numbered = ranked(orders.select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey")
    return numbered.join(stops, F.col("l_orderkey") == F.col("o_orderkey")).select(trip_id(F.col("rank")).alias("trip_id"), F.col("o_orderkey").alias("train"), "stops", "suppliers")


def sorted_output(trains: DataFrame, orders: DataFrame) -> DataFrame:
    """(train, pos): merged trains in order of their first day, those without one last."""
    firsts = trains.select(F.col("key").alias("train")).distinct().join(orders.where("o_orderkey % 5 <> 0").groupBy(F.col("o_orderkey").alias("train")).agg(F.min("o_orderdate").cast("string").alias("day")), "train", "left")
    return ranked(firsts.withColumn("day", F.coalesce("day", F.lit("99:99"))), "day", "train", name="pos").select("train", "pos")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), F.lit(" (Ōmiya)・X’s-y_z")).alias("name"))
    other = read(spark, sf_dir, "part").select((F.col("p_partkey") + 100000000).alias("id"), F.concat(F.lit("\t駅（"), F.col("p_name"), F.lit("）, St. a/b ")).alias("name"))
    return some.unionByName(other).select("id", normal_name(F.col("name")).alias("name"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(k, F.when(k % 3 > 0, F.col("p_brand")).alias("service"), F.when(k % 2 > 0, k.cast("string")).otherwise("").alias("number"), F.when(k % 5 > 0, F.col("p_name")).alias("display"))
    return rows.select(k.alias("id"), train_label(F.col("service"), F.col("number"), F.col("display"), k.cast("string")).alias("label"))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    hhmm = F.date_format(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.floor(F.pmod("minute", F.lit(1440)) / 60).cast("int"), F.pmod("minute", F.lit(60)).cast("int"), F.lit(0)), "HH:mm")
    rows = stop_times(read(spark, sf_dir, "events")).withColumn("hhmm", hhmm)
    return rows.select("trip_id", "seq", "hhmm", seconds_of(F.col("hhmm")).alias("seconds"), whole_minutes(seconds_of(F.col("hhmm")) + 59).alias("minutes"), minutes_of(F.col("hhmm")).alias("again"))


QUERIES = {
    "normalize_names": _names,
    "merge_by_service_key": lambda spark, sf_dir: merged(source_trains(read(spark, sf_dir, "lineitem"))),
    "merge_steps_by_key": lambda spark, sf_dir: merge_steps(source_trains(read(spark, sf_dir, "lineitem"))),
    "trip_instances": lambda spark, sf_dir: instances(*(read(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))),
    "merge_sorted_output": lambda spark, sf_dir: sorted_output(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), read(spark, sf_dir, "orders")),
    "train_labels": _labels,
    "clock_seconds": _times,
}

_SOURCES = """
t AS (SELECT l_returnflag AS dataset, CAST(l_orderkey AS VARCHAR) AS train, count(*) AS n, CASE l_orderkey % 4 WHEN 0 THEN 'のぞみ' WHEN 1 THEN 'Nozomi' WHEN 3 THEN '' END AS service, CAST(l_orderkey // 2 AS VARCHAR) AS number FROM lineitem GROUP BY l_returnflag, l_orderkey),
k AS (SELECT *, CASE WHEN CAST(train AS BIGINT) % 4 < 2 THEN 'service::Nozomi::' || number ELSE 'train::' || train END AS merge_key FROM t)"""
ORACLE = {
    "normalize_names": """
SELECT c_custkey AS id, replace(lower(c_name), ' ', '') || 'ōmiyaxsyz' AS name FROM customer
UNION ALL SELECT p_partkey + 100000000, '駅' || regexp_replace(lower(p_name), '[^a-z0-9#]', '', 'g') || 'stab' FROM part""",
    "merge_by_service_key": f"""
WITH {_SOURCES}, b AS (SELECT merge_key, max(n) AS most, count(*) AS sources FROM k GROUP BY merge_key),
w AS (SELECT k.merge_key, min(dataset || lpad(train, 20, ' ')) AS first FROM k JOIN b ON b.merge_key = k.merge_key AND n = most GROUP BY k.merge_key)
SELECT dataset, train, service, number, n, k.merge_key, sources FROM k JOIN b USING (merge_key) WHERE n = most AND NOT EXISTS (
  SELECT 1 FROM k o WHERE o.merge_key = k.merge_key AND o.n = most AND (o.dataset, o.train) < (k.dataset, k.train))""",
    "merge_steps_by_key": f"""
WITH {_SOURCES}, p AS (SELECT a.merge_key, a.train, a.dataset, a.n, max(b.n) AS best FROM k a JOIN k b ON a.merge_key = b.merge_key AND (b.dataset, b.train) < (a.dataset, a.train) GROUP BY ALL)
SELECT merge_key, train, dataset, CASE WHEN n > best THEN 'replaced_with_longer_stop_list' ELSE 'kept_existing_longer_or_equal_stop_list' END AS resolution, greatest(n, best) AS kept_stop_count, least(n, best) AS dropped_stop_count FROM p""",
    "trip_instances": """
SELECT printf('TRIP_%05d', rn) AS trip_id, o_orderkey AS train, stops, suppliers FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
JOIN (SELECT l_orderkey, count(*) AS stops, count(DISTINCT s_nationkey) AS suppliers FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "merge_sorted_output": """
SELECT train, row_number() OVER (ORDER BY day, train) AS pos FROM (SELECT DISTINCT l_orderkey AS train, coalesce((SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 5 <> 0), '99:99') AS day FROM lineitem)""",
    "train_labels": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 THEN p_brand || ' ' || p_partkey WHEN p_partkey % 3 > 0 THEN p_brand WHEN p_partkey % 5 > 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS label FROM part",
    "clock_seconds": f"SELECT trip_id, seq, strftime(TIMESTAMP '2024-01-01' + to_minutes(minute), '%H:%M') AS hhmm, minute % 1440 * 60 AS seconds, minute % 1440 AS minutes, minute % 1440 AS again FROM {SQL['st']}",
}
