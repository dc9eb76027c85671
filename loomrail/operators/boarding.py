"""What can be boarded, where a trip goes on, and how it moves along its route."""

QUERIES = {
    # first catchable visit of each trip at a station from a minute on, the first eight trips
    "next_departures_topk": """
SELECT station_id, trip_id, dep, CAST(rn AS BIGINT) AS rank FROM (
  SELECT station_id, trip_id, dep, row_number() OVER (PARTITION BY station_id ORDER BY dep, trip_id) AS rn FROM (
    SELECT station_id, trip_id, min(dep) AS dep FROM {st} WHERE dep >= 600 GROUP BY station_id, trip_id) a) b
WHERE rn <= 8""",
    "loop_pass_index": "SELECT trip_id, seq, station_id, CAST(row_number() OVER (PARTITION BY trip_id, station_id ORDER BY seq) AS BIGINT) AS loop_pass_index FROM {st}",
    "segments": """
SELECT trip_id, seq, station_id AS from_station, to_station, dep, arr FROM (
  SELECT *, lead(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS to_station, lead(minute) OVER (PARTITION BY trip_id ORDER BY seq) AS arr FROM {st}) a
WHERE to_station IS NOT NULL""",
    "consecutive_dedupe": """
SELECT trip_id, seq, station_id FROM (SELECT *, lag(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS prev FROM {st}) a
WHERE prev IS NULL OR prev <> station_id""",
    "direction_inference": """
SELECT t.trip_id, coalesce(d.direction, 'unknown') AS direction FROM (SELECT DISTINCT trip_id FROM {st}) t LEFT JOIN (
  SELECT trip_id, CASE WHEN (nxt - station_id + 25) % 25 <= (station_id - nxt + 25) % 25 THEN 'forward' ELSE 'backward' END AS direction,
         row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS rn FROM (
    SELECT *, lead(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS nxt FROM {st}) a WHERE nxt IS NOT NULL AND nxt <> station_id) d
ON t.trip_id = d.trip_id AND d.rn = 1""",
    "unwrap_offsets": """
SELECT trip_id, seq, station_id, CAST(station_id + 25 * sum(wrap) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y FROM (
  SELECT trip_id, seq, station_id, CASE WHEN station_id - prev > 12 THEN -1 WHEN station_id - prev < -12 THEN 1 ELSE 0 END AS wrap FROM (
    SELECT *, lag(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS prev FROM {st}) a) b""",
    "hour_ticks": """
SELECT CAST(h * 60 AS INTEGER) AS tick FROM (
  SELECT [[explode(sequence(lo, hi))||unnest(range(lo, hi + 1))]] AS h FROM (SELECT CAST(floor(min(minute) / 60) AS BIGINT) AS lo, CAST(ceil(max(minute) / 60) AS BIGINT) AS hi FROM {st}) a) b""",
    "panel_train_counts": """
SELECT panel, count(*) AS trains FROM (
  SELECT station_id % 5 AS panel, trip_id FROM {st} GROUP BY station_id % 5, trip_id HAVING count(*) >= 2) a GROUP BY panel""",
    # stops after the first visit of the trip until the boarded station comes again, which is the last of them
    "future_stops_until_return": """
SELECT s.trip_id, s.seq, s.station_id FROM {st} s JOIN (
  SELECT a.trip_id, a.seq AS boarded, min(b.seq) AS again FROM {st} a LEFT JOIN {st} b ON a.trip_id = b.trip_id AND a.station_id = b.station_id AND b.seq > a.seq
  WHERE a.seq = 1 GROUP BY a.trip_id, a.seq) r
ON s.trip_id = r.trip_id AND s.seq > r.boarded AND (r.again IS NULL OR s.seq <= r.again)""",
    "nearest_stop_in_time": """
SELECT trip_id, at_minute, seq, station_id FROM (
  SELECT trip_id, m AS at_minute, seq, station_id, row_number() OVER (PARTITION BY trip_id, m ORDER BY abs(minute - m), seq) AS rn FROM {st} CROSS JOIN (VALUES (600), (5000), (20000)) v(m)) a
WHERE rn = 1""",
    # on a leg at the minute, between the stop left and the next one
    "train_position_at": """
SELECT trip_id, m AS at_minute, station_id AS from_station, nxt AS to_station,
       round(CASE WHEN nxt IS NULL OR arr = dep THEN 1.0 ELSE least(greatest(CAST(m - dep AS DOUBLE) / (arr - dep), 0.0), 1.0) END, 6) AS progress FROM (
  SELECT v.m, s.*, row_number() OVER (PARTITION BY trip_id, v.m ORDER BY seq DESC) AS rn FROM (
    SELECT trip_id, seq, station_id, minute, dep, lead(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS nxt, lead(minute) OVER (PARTITION BY trip_id ORDER BY seq) AS arr FROM {st}) s
  JOIN (VALUES (600), (5000), (20000)) v(m) ON s.minute <= v.m) a
WHERE rn = 1""",
    "reachable_semi": """
SELECT DISTINCT n_nationkey AS station_id, n_name AS name FROM {nation} WHERE n_nationkey IN (
  SELECT b.station_id FROM {st} a JOIN {st} b ON a.trip_id = b.trip_id AND b.seq > a.seq WHERE a.station_id = 3 AND a.minute BETWEEN 600 AND 2000)""",
    "hhmm_roundtrip": """
SELECT trip_id, seq, hhmm, CAST(substr(hhmm, 1, length(hhmm) - 3) AS INTEGER) * 60 + CAST(substr(hhmm, length(hhmm) - 1, 2) AS INTEGER) AS back FROM (
  SELECT trip_id, seq, concat(CASE WHEN minute < 600 THEN '0' ELSE '' END, CAST(CAST(floor(minute / 60) AS INTEGER) AS [[STRING||VARCHAR]]), ':', CASE WHEN minute % 60 < 10 THEN '0' ELSE '' END, CAST(minute % 60 AS [[STRING||VARCHAR]])) AS hhmm FROM {st}) a""",
    "coalesced_times": """
SELECT trip_id, seq, coalesce(d, a) AS departure, coalesce(a, d) AS arrival FROM (
  SELECT trip_id, seq, CASE WHEN event_id % 4 = 1 THEN NULL ELSE minute END AS a, CASE WHEN event_id % 4 = 2 THEN NULL ELSE dep END AS d FROM {st}) x""",
    # running visits that keep the last known station where every third one is unknown
    "gap_interpolate": """
SELECT trip_id, seq, CASE WHEN y IS NOT NULL THEN y WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE round(y0 + (y1 - y0) * (seq - s0) / (s1 - s0), 6) END AS y FROM (
  SELECT g.trip_id, g.seq, g.y, g.s0, g.s1, CAST(p.station_id AS DOUBLE) AS y0, CAST(n.station_id AS DOUBLE) AS y1 FROM (
    SELECT trip_id, seq, CASE WHEN seq % 3 = 1 THEN CAST(station_id AS DOUBLE) END AS y,
      max(CASE WHEN seq % 3 = 1 THEN seq END) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0,
      min(CASE WHEN seq % 3 = 1 THEN seq END) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1 FROM {st}) g
  LEFT JOIN {st} p ON p.trip_id = g.trip_id AND p.seq = g.s0 LEFT JOIN {st} n ON n.trip_id = g.trip_id AND n.seq = g.s1) a""",
}
