"""Tiles of a map: which tiles each feature's box meets, from the finest level upwards, and the tiles written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.operators.maps import features, layers, stations
from loomrail.sources.adapters import SQL, points, read
from loomrail.sources.documents import write_tiles
from loomrail.sources.storage import new_folder

# The box that the tiles divide, and the levels that are built.
WEST, EAST, SOUTH, NORTH = 128.0, 146.5, 30.0, 46.5
LEVELS = (3, 6)


def span(low: Column, high: Column, start: Column, end: Column, count: int, width: float, upwards: bool) -> tuple[Column, Column]:
    """The first and last of `count` equal parts of [start, end] that meet [low, high], ends included; the first is after the last where none does.

    A part is guessed from the share, and put right by comparing with the parts' own edges.
    """
    origin, far = (start, 1.0) if upwards else (end, -1.0)
    edge = lambda i: origin + F.lit(far * width) * (i / F.lit(float(count)))
    near, away = (low, high) if upwards else (high, low)
    guess = lambda v: F.greatest(F.lit(-2), F.least(F.lit(count + 1), F.floor((v - origin) * far / width * count))).cast("int")
    around = lambda g: F.sequence(g - 1, g + 1)
    beyond = (lambda a, b: a >= b) if upwards else (lambda a, b: a <= b)
    first = F.array_min(F.filter(around(guess(near)), lambda i: beyond(edge(i + 1), near)))
    last = F.array_max(F.filter(around(guess(away)), lambda i: beyond(away, edge(i))))
    return F.greatest(F.coalesce(first, F.lit(count)), F.lit(0)), F.least(F.coalesce(last, F.lit(-1)), F.lit(count - 1))


def pyramid(boxes: DataFrame, levels: tuple[int, int] = LEVELS) -> DataFrame:
    """boxes (min_lon, min_lat, max_lon, max_lat and others) once for every tile (z, x, y) that they meet, edges included.

    Tiles are found at the finest level as a rectangle of columns and rows; each level's rectangle comes
    from the one below it, as a tile is met where one of its four is. Boxes outside all tiles are left out.
    """
    low, high = levels
    n = 1 << high
    x0, x1 = span(F.col("min_lon"), F.col("max_lon"), F.lit(WEST), F.lit(EAST), n, EAST - WEST, True)
    y0, y1 = span(F.col("min_lat"), F.col("max_lat"), F.lit(SOUTH), F.lit(NORTH), n, NORTH - SOUTH, False)
    finest = boxes.select("*", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).where("x0 <= x1 AND y0 <= y1")
    level = lambda z: F.transform(F.expr(f"sequence(shiftright(x0, {high - z}), shiftright(x1, {high - z}))"), lambda x: F.transform(F.expr(f"sequence(shiftright(y0, {high - z}), shiftright(y1, {high - z}))"), lambda y: F.struct(F.lit(z).alias("z"), x.alias("x"), y.alias("y"))))
    every = F.flatten(F.concat(*(level(z) for z in range(low, high + 1))))
    return finest.select(*boxes.columns, F.inline(every))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, pos, lon, lat, offset): points of one cell of half a degree, at most 64 to a line."""
    pt = points(read(spark, sf_dir, "embeddings"))
    cell = F.floor(F.col("lon") * 2) * 1000 + F.floor(F.col("lat") * 2)
    line = cell * 1000000 + F.floor(F.col("point_id") / 64)
    return pt.select(line.alias("line_id"), F.col("point_id").alias("pos"), "lon", "lat", (F.col("point_id") % 3).alias("offset"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(stations(spark, sf_dir), lines(spark, sf_dir))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of each layer each tile of each level holds, and the sum of their ids."""
    met = pyramid(_boxes(spark, sf_dir).select("layer", "id", "min_lon", "min_lat", "max_lon", "max_lat"))
    return met.groupBy("layer", "z", "x", "y").agg(F.count("*").alias("features"), F.sum("id").alias("ids"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole features written into every tile they meet."""
    rows = _boxes(spark, sf_dir)
    met = pyramid(rows.select("layer", "id", "min_lon", "min_lat", "max_lon", "max_lat")).select("layer", "id", "z", "x", "y")
    return write_tiles(met.join(features(rows), ["layer", "id"]).select("layer", "z", "x", "y", "feature"), new_folder(spark, "tiles"), most=50)


QUERIES = {"line_tile_features": _tiles, "line_tile_manifest": _manifest}

_BOXES = f"""b AS (SELECT 'stations' AS layer, n_nationkey::BIGINT AS id, 128.0::DOUBLE + n_nationkey * 0.5 AS x0, 31.0::DOUBLE + n_nationkey * 7 % 25 * 0.5 AS y0, 128.0::DOUBLE + n_nationkey * 0.5 AS x1, 31.0::DOUBLE + n_nationkey * 7 % 25 * 0.5 AS y1 FROM nation WHERE n_nationkey % 9 <> 8
  UNION ALL SELECT 'lines', (CAST(floor(lon * 2) AS BIGINT) * 1000 + CAST(floor(lat * 2) AS BIGINT)) * 1000000 + point_id // 64 AS id, min(lon), min(lat), max(lon), max(lat) FROM {SQL['pt']} GROUP BY 2 HAVING count(*) > 1),
t AS (SELECT z, x, y, 128.0::DOUBLE + 18.5::DOUBLE * (x / (1 << z)) AS w, 128.0::DOUBLE + 18.5::DOUBLE * ((x + 1) / (1 << z)) AS e, 46.5::DOUBLE - 16.5::DOUBLE * (y / (1 << z)) AS n, 46.5::DOUBLE - 16.5::DOUBLE * ((y + 1) / (1 << z)) AS s
  FROM (SELECT unnest([3, 4, 5, 6]) AS z) l, range(64) r(x), range(64) q(y) WHERE x < (1 << z) AND y < (1 << z)),
m AS (SELECT layer, z, x, y, count(*) AS features, sum(id)::BIGINT AS ids FROM b JOIN t ON NOT (x1 < w OR x0 > e OR y1 < s OR y0 > n) GROUP BY ALL)"""
ORACLE = {
    "line_tile_features": f"WITH {_BOXES} SELECT layer, z, x::INTEGER AS x, y::INTEGER AS y, features, ids FROM m",
    "line_tile_manifest": f"WITH {_BOXES} SELECT layer, z, count(*) AS tiles, sum(features)::BIGINT AS features FROM m GROUP BY layer, z",
}
