"""Places on a linear tile pyramid, distances, boxes, labels."""

_INDEX = "CAST(floor((lon - 128.0) / 18.5 * {n}) AS INTEGER) AS x, CAST(floor((46.5 - lat) / 16.5 * {n}) AS INTEGER) AS y"
_BOXES = "SELECT point_id, lon - 0.2 AS lo, lon + 0.2 AS hi, lat - 0.2 AS bot, lat + 0.2 AS top FROM {pt}"
# index ranges of the boxes first, then an equality-free expansion of the few tiles in range, then the exact test
_TILES = """SELECT b.point_id, z.z, tx.x, ty.y FROM ({boxes}) b CROSS JOIN (VALUES {levels}) z(z, n)
  {expand_x} {expand_y}
  WHERE b.hi >= 128.0 + 18.5 * tx.x / z.n AND b.lo <= 128.0 + 18.5 * (tx.x + 1) / z.n AND b.top >= 46.5 - 16.5 * (ty.y + 1) / z.n AND b.bot <= 46.5 - 16.5 * ty.y / z.n"""


def _range(low: str, high: str, name: str) -> str:
    lo, hi = (f"CAST(greatest(0, least(z.n - 1, {e})) AS BIGINT)" for e in (f"ceil({low}) - 1", f"floor({high})"))
    return f"[[LATERAL VIEW explode(sequence({lo}, {hi})) t{name} AS {name}||CROSS JOIN LATERAL (SELECT unnest(range({lo}, {hi} + 1)) AS {name}) t{name}]]"


def _tiles(levels: str) -> str:
    x = _range("(b.lo - 128.0) / 18.5 * z.n", "(b.hi - 128.0) / 18.5 * z.n", "x")
    y = _range("(46.5 - b.top) / 16.5 * z.n", "(46.5 - b.bot) / 16.5 * z.n", "y")
    return _TILES.replace("{boxes}", _BOXES).replace("{levels}", levels).replace("{expand_x}", x).replace("{expand_y}", y)


QUERIES = {
    "tile_assign_z3": _tiles("(3, 8)"),
    "tile_pyramid_counts": f"SELECT z, x, y, count(*) AS features FROM ({_tiles('(3, 8), (4, 16), (5, 32), (6, 64)')}) t GROUP BY z, x, y",
    "project_points": """
SELECT point_id, round((lon - min_lon) / CASE WHEN max_lon = min_lon THEN 1 ELSE max_lon - min_lon END * 960 + 20, 2) AS px, round((max_lat - lat) / CASE WHEN max_lat = min_lat THEN 1 ELSE max_lat - min_lat END * 600 + 20, 2) AS py
FROM {pt} CROSS JOIN (SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM {pt}) b""",
    "polyline_bbox": """
SELECT line, count(*) AS points, round(min(lon), 6) AS min_lon, round(min(lat), 6) AS min_lat, round(max(lon), 6) AS max_lon, round(max(lat), 6) AS max_lat FROM (SELECT point_id % 20 AS line, lon, lat FROM {pt}) a GROUP BY line HAVING count(*) >= 2""",
    "shape_distance": """
SELECT line, point_id, round(coalesce(sum(d) OVER (PARTITION BY line ORDER BY point_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 3) AS dist FROM (
  SELECT line, point_id, 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (
    SELECT line, point_id, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM (
      SELECT point_id % 20 AS line, point_id, lon, lat, lag(lon) OVER (PARTITION BY point_id % 20 ORDER BY point_id) AS lon0, lag(lat) OVER (PARTITION BY point_id % 20 ORDER BY point_id) AS lat0 FROM {pt}) a) b) c""",
}
