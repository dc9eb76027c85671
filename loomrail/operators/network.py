"""Network summaries and quality rules."""

QUERIES = {
    "adjacency_pairs": """
SELECT a, b, count(*) AS trips, count(DISTINCT region) AS routes FROM (
  SELECT least(station_id, nxt) AS a, greatest(station_id, nxt) AS b, n_regionkey AS region FROM (
    SELECT *, lead(station_id) OVER (PARTITION BY trip_id ORDER BY seq) AS nxt FROM {st}) s JOIN {nation} ON n_nationkey = station_id WHERE nxt IS NOT NULL AND nxt <> station_id) p
GROUP BY a, b""",
    "interchange_stations": """
SELECT station_id, routes FROM (SELECT station_id, count(DISTINCT trip_id % 5) AS routes FROM {st} GROUP BY station_id) a WHERE routes > 1""",
    "service_families": "SELECT DISTINCT coalesce(nullif(trim(regexp_extract(p_type, '^([A-Za-z]+)', 1)), ''), 'other') AS family FROM {part}",
    "route_summary_left": """
SELECT r_regionkey AS route_id, r_name AS name, coalesce(trains, 0) AS trains FROM {region} LEFT JOIN (
  SELECT n_regionkey, count(*) AS trains FROM {st} JOIN {nation} ON n_nationkey = station_id WHERE seq = 1 AND n_regionkey <> 2 GROUP BY n_regionkey) t ON n_regionkey = r_regionkey""",
    "route_concat": """
SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY part, pos) AS BIGINT) AS pos, station FROM (
  SELECT *, lag(station) OVER (PARTITION BY route ORDER BY part, pos) AS prev FROM (
    SELECT n_regionkey AS route, 1 AS part, n_nationkey AS pos, n_nationkey AS station FROM {nation}
    UNION ALL SELECT n_regionkey AS route, 2 AS part, 100 - n_nationkey AS pos, n_nationkey AS station FROM {nation}) a) b
WHERE prev IS NULL OR prev <> station""",
    "quality_violations": """
SELECT rule, CAST(k AS BIGINT) AS k, count(*) AS n FROM (
  SELECT 'time_goes_backwards' AS rule, trip_id AS k FROM (SELECT *, lag(dep) OVER (PARTITION BY trip_id ORDER BY seq) AS prev FROM {st}) a WHERE minute < prev
  UNION ALL SELECT 'repeated_key' AS rule, l_orderkey AS k FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'long_dwell' AS rule, trip_id AS k FROM {st} WHERE dep - minute >= 2
  UNION ALL SELECT 'unknown_station' AS rule, trip_id AS k FROM {st} s WHERE NOT EXISTS (SELECT 1 FROM {nation} n WHERE n.n_nationkey = s.station_id AND n.n_nationkey <> 7)) v
GROUP BY rule, k""",
    "set_equality_check": """
SELECT 'missing' AS side, n_nationkey AS id FROM {nation} n WHERE NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey % 2 = 0)
UNION ALL SELECT DISTINCT 'extra' AS side, s_nationkey AS id FROM {supplier} s WHERE s_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM {nation} n WHERE n.n_nationkey = s.s_nationkey AND n.n_nationkey < 20)""",
    "station_sequence_complete": """
SELECT w.i AS missing FROM (SELECT [[explode(sequence(0L, 24L))||unnest(range(0, 25))]] AS i) w LEFT JOIN {nation} n ON n.n_nationkey = w.i AND n.n_nationkey % 5 <> 0 WHERE n.n_nationkey IS NULL""",
    "summary_counts": "SELECT event_type AS kind, count(*) AS n, count(DISTINCT trip_id) AS trips, min(minute) AS first_minute, max(minute) AS last_minute FROM {st} GROUP BY event_type",
}
