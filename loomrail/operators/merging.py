"""Competing sources of the same trains: deduplication, merging, reports, and resolution of names."""

QUERIES = {
    "dedupe_longest": "SELECT train, source, n FROM (SELECT *, row_number() OVER (PARTITION BY train ORDER BY n DESC, source) AS rn FROM {src}) a WHERE rn = 1",
    "merge_sources_longest": """
SELECT train, CASE WHEN source = 'A' THEN 1 WHEN source = 'N' THEN 2 ELSE 3 END AS dataset_pos, n AS kept_stops, sources FROM (
  SELECT *, count(*) OVER (PARTITION BY train) AS sources, row_number() OVER (PARTITION BY train ORDER BY n DESC, source) AS rn FROM {src}) a WHERE rn = 1""",
    "merge_report": """
SELECT train, source, CASE WHEN n > best THEN 'replaced_with_longer_stop_list' ELSE 'kept_existing_longer_or_equal_stop_list' END AS resolution,
       greatest(n, best) AS kept_stop_count, least(n, best) AS dropped_stop_count FROM (
  SELECT *, max(n) OVER (PARTITION BY train ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {src}) a WHERE best IS NOT NULL""",
    "service_name_split": """
SELECT p_partkey AS id, coalesce(a.alias, raw) AS service, number FROM (
  SELECT p_partkey, regexp_extract(p_brand, '^(.*?)([0-9]+)$', 1) AS raw, regexp_extract(p_brand, '^(.*?)([0-9]+)$', 2) AS number FROM {part}) p
LEFT JOIN (VALUES ('Brand#', 'Brand')) a(name, alias) ON a.name = p.raw""",
    # a name for the station on this line comes before the name alone; unresolved stays null
    "resolve_with_override": """
SELECT s.trip_id, s.seq, coalesce(o.id, n.id) AS resolved FROM {st} s
LEFT JOIN (SELECT n_nationkey AS k, n_regionkey AS line, n_nationkey + 1000 AS id FROM {nation} WHERE n_nationkey % 4 = 0) o ON o.k = s.station_id AND o.line = s.trip_id % 5
LEFT JOIN (SELECT n_nationkey AS k, n_nationkey AS id FROM {nation} WHERE n_nationkey % 7 <> 0) n ON n.k = s.station_id""",
    "unresolved_keys": "SELECT DISTINCT s_nationkey AS station_id FROM {supplier} s LEFT ANTI JOIN {nation} n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey % 3 <> 0".replace("LEFT ANTI JOIN", "[[LEFT ANTI||ANTI]] JOIN"),
    "coordinate_enrichment": """
SELECT s.s_suppkey AS id, CASE WHEN m.n_nationkey IS NOT NULL THEN 'manual' WHEN p.point_id IS NOT NULL THEN 'primary' WHEN q.point_id IS NOT NULL THEN 'secondary' ELSE 'missing' END AS status,
       round(coalesce(CAST(m.n_nationkey AS DOUBLE), p.lat, q.lat), 3) AS lat FROM {supplier} s
LEFT JOIN {nation} m ON m.n_nationkey = s.s_nationkey AND m.n_nationkey % 6 = 0
LEFT JOIN {pt} p ON p.point_id = s.s_suppkey AND s.s_suppkey % 2 = 0
LEFT JOIN {pt} q ON q.point_id = s.s_suppkey + 1 AND s.s_suppkey % 3 = 0""",
    "grid_group_argminmax": """
SELECT service, number, station, pos FROM (
  SELECT service, number, station, first_pos, CAST(row_number() OVER (PARTITION BY service, number ORDER BY dep, station) AS BIGINT) AS pos FROM (
    SELECT l_returnflag AS service, l_orderkey AS number, l_linenumber AS station, min(l_shipdate) AS dep,
           min(CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END) AS first_pos FROM {lineitem} GROUP BY l_returnflag, l_orderkey, l_linenumber) a) b
WHERE service <> 'R'""",
}
