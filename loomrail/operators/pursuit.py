"""Players on trips: states over time, first encounters, clocks and visibility. A match pairs trip 2m (runner) with trip 2m + 1 (hunter)."""

QUERIES = {
    "player_state_at_minute": """
SELECT trip_id, m AS at_minute, station_id, event_type FROM (
  SELECT s.*, v.m, row_number() OVER (PARTITION BY s.trip_id, v.m ORDER BY s.seq DESC) AS rn FROM {st} s JOIN (VALUES (600), (5000), (20000)) v(m) ON s.minute <= v.m) a WHERE rn = 1""",
    "hourly_planning_windows": """
SELECT trip_id, CAST(floor((minute - 360) / 60) AS BIGINT) AS window_no, count(*) AS events, min(minute) AS first_minute, max(minute) AS last_minute FROM {st} GROUP BY trip_id, CAST(floor((minute - 360) / 60) AS BIGINT)""",
    "visibility_projection": """
SELECT trip_id, seq, CASE WHEN minute % 1440 < 360 THEN 'hidden' WHEN trip_id % 2 = 0 AND event_type = 'click' THEN 'segment' WHEN trip_id % 2 = 0 THEN 'station' ELSE 'full' END AS shown FROM {st}""",
    "hop_replay_states": """
SELECT trip_id, seq, coalesce(lag(station_id) OVER (PARTITION BY trip_id ORDER BY seq), -1) AS state_before, station_id AS state_after, CASE WHEN seq <= count(*) OVER (PARTITION BY trip_id) / 2 THEN 'DONE' ELSE 'NEXT' END AS mark FROM {st}""",
}
