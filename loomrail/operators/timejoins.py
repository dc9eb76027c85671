"""Joins by time: the last fact at or before a probe, and pairs of intervals that overlap.

Neither compares rows of different stretches of time. A key with many rows is dealt by stretches, of
which only one row each is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.sources.adapters import SQL, read, stop_times


def as_of(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, tie: str, stretch: int = 1440) -> DataFrame:
    """probes with `fact`, a struct of the last row of facts of the same key at or before the probe's time, null if there is none.

    Times are whole numbers; of facts of one time the greatest `tie` counts. Null keys and times find
    nothing, and null times of facts are never found. Facts and probes are sorted together once, each
    stretch of a key on its own; the last fact of each stretch is then carried over those after it, so
    a key's rows never need one task.
    """
    f = facts.where(F.col(key).isNotNull() & F.col(fact_time).isNotNull()).select(F.col(key).alias("k"), F.col(fact_time).cast("long").alias("t"), F.col(tie).cast("long").alias("tie"), F.struct(*facts.columns).alias("fact"))
    p = probes.select(F.col(key).alias("k"), F.col(probe_time).cast("long").alias("t"), F.struct(*probes.columns).alias("probe"))
    both = f.unionByName(p, allowMissingColumns=True).withColumn("stretch", F.floor(F.col("t") / stretch))
    order = Window.partitionBy("k", "stretch").orderBy("t", F.col("probe").isNotNull(), "tie")
    seen = both.withColumn("near", F.last("fact", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each key and stretch
    ends = both.groupBy("k", "stretch").agg(F.max_by("fact", F.when(F.col("fact").isNotNull(), F.struct("t", "tie"))).alias("end"))
    before = ends.withColumn("far", F.last("end", True).over(Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).select("k", "stretch", "far")
    asked = seen.where("probe IS NOT NULL").alias("s").join(before.alias("b"), F.col("s.k").eqNullSafe(F.col("b.k")) & F.col("s.stretch").eqNullSafe(F.col("b.stretch")), "left")
    known = F.col("s.k").isNotNull() & F.col("s.t").isNotNull()
    return asked.select("s.probe.*", F.when(known, F.coalesce("s.near", "b.far")).alias("fact"))


def overlapping_pairs(spans: DataFrame, key: str, begin: str, end: str, number: str, stretch: int = 60, different: Column | None = None) -> DataFrame:
    """(a, b): pairs of rows of one key whose intervals share a point, ends included, once each with a's number below b's.

    An interval goes into every stretch of time it meets, and a pair counts in the stretch where the
    later of the two begins, so it is found once. Rows of one key meet only within a stretch. Intervals
    that end before they begin, and null keys or ends, meet nothing. `different` is a further condition
    on a and b.
    """
    rows = spans.where(F.col(key).isNotNull() & (F.col(begin) <= F.col(end))).select(F.col(key).alias("k"), F.col(begin).alias("b0"), F.col(end).alias("e0"), F.col(number).alias("n"), F.struct(*spans.columns).alias("row"))
    dealt = rows.select("*", F.explode(F.sequence(F.floor(F.col("b0") / stretch), F.floor(F.col("e0") / stretch))).alias("stretch"))
    left, right = (dealt.select("k", "stretch", *(F.col(c).alias(f"{c}_{s}") for c in ("b0", "e0", "n")), F.col("row").alias(s)) for s in ("a", "b"))
    later = F.greatest("b0_a", "b0_b")
    met = left.join(right, ["k", "stretch"]).where((F.col("n_a") < F.col("n_b")) & (later <= F.least("e0_a", "e0_b")) & (F.floor(later / stretch) == F.col("stretch")))
    return (met if different is None else met.where(different)).select("a", "b")


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_times(read(spark, sf_dir, "events"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next trip is at the time of every visit: at a station, or how far on its leg; before its first visit it is nowhere."""
    visits = _visits(spark, sf_dir)
    order = Window.partitionBy("trip_id").orderBy("seq")
    legs = visits.select("trip_id", "seq", "station_id", "minute", "dep", F.lead("station_id").over(order).alias("to_station"), F.lead("minute").over(order).alias("arr"))
    probes = visits.select("event_id", (F.col("trip_id") + 1).alias("trip_id"), F.col("minute").alias("at_minute"))
    f = "fact."
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at_minute") - F.col(f + "dep")) / F.greatest(F.lit(1), F.col(f + "arr") - F.col(f + "dep"))))
    got = as_of(probes, legs, "trip_id", "at_minute", "minute", "seq")
    return got.select("event_id", "trip_id", "at_minute", F.col(f + "seq").alias("seq"), F.col(f + "station_id").alias("from_station"), F.col(f + "to_station").alias("to_station"), F.when(F.col(f + "to_station").isNotNull(), share).alias("progress"))


def _opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other player of a match (trips 2m and 2m + 1) did last at the time of each event, and how long ago."""
    visits = _visits(spark, sf_dir)
    probes = visits.select("event_id", (F.col("trip_id") + 1 - F.col("trip_id") % 2 * 2).alias("trip_id"), F.col("minute").alias("at_minute"))
    got = as_of(probes, visits, "trip_id", "at_minute", "minute", "seq")
    return got.select("event_id", "trip_id", F.coalesce("fact.event_type", F.lit("none")).alias("last_action"), "fact.station_id", (F.col("at_minute") - F.col("fact.minute")).alias("ago"))


def _together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of trips that stand at a station at the same time, and from when to when."""
    met = overlapping_pairs(_visits(spark, sf_dir), "station_id", "minute", "dep", "event_id", different=F.col("a.trip_id") != F.col("b.trip_id"))
    return met.select("a.station_id", F.col("a.event_id").alias("event_a"), F.col("b.event_id").alias("event_b"), F.greatest("a.minute", "b.minute").alias("since"), F.least("a.dep", "b.dep").alias("until"))


QUERIES = {"asof_positions": _positions, "asof_opponents": _opponents, "trains_together": _together}
_V = f"v AS (SELECT * FROM {SQL['st']}), d AS (SELECT * FROM (SELECT *, lead(station_id) OVER w AS nxt, lead(minute) OVER w AS arr FROM v WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) QUALIFY row_number() OVER (PARTITION BY trip_id, minute ORDER BY seq DESC) = 1)"
ORACLE = {
    "asof_positions": f"""WITH {_V}, p AS (SELECT event_id, trip_id + 1 AS trip_id, minute AS at_minute FROM v)
SELECT p.event_id, p.trip_id, at_minute, d.seq, d.station_id AS from_station, nxt AS to_station, CASE WHEN nxt IS NULL THEN NULL WHEN at_minute <= d.dep THEN 0.0 WHEN arr - d.dep < 1 THEN 1.0 ELSE least((at_minute - d.dep) / (arr - d.dep), 1.0) END::DOUBLE AS progress
FROM p ASOF LEFT JOIN d ON p.trip_id = d.trip_id AND p.at_minute >= d.minute""",
    "asof_opponents": f"""WITH {_V}, p AS (SELECT event_id, CASE WHEN trip_id % 2 = 0 THEN trip_id + 1 ELSE trip_id - 1 END AS trip_id, minute AS at_minute FROM v)
SELECT p.event_id, p.trip_id, coalesce(d.event_type, 'none') AS last_action, d.station_id, at_minute - d.minute AS ago FROM p ASOF LEFT JOIN d ON p.trip_id = d.trip_id AND p.at_minute >= d.minute""",
    "trains_together": f"""WITH {_V} SELECT a.station_id, a.event_id AS event_a, b.event_id AS event_b, greatest(a.minute, b.minute) AS since, least(a.dep, b.dep) AS until
FROM v a JOIN v b ON a.station_id = b.station_id AND a.event_id < b.event_id AND a.trip_id <> b.trip_id AND a.minute <= b.dep AND b.minute <= a.dep""",
}
