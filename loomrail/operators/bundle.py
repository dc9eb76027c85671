"""The network as ten linked tables: stations, groups, labels, nodes, lines, routes, patterns, geometry, trips and their times.

Tables refer to one another by ids made of a prefix and the source's id. A dictionary of station
sequences gives equal sequences of stops one number, and references are checked by anti joins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.functions import trip_id
from loomrail.sources.adapters import read
from loomrail.sources.documents import union_all
from loomrail.sources.storage import new_folder, ranked

# Prefixes of ids, ranks and zooms of hubs and others, what geometry is drawn for which zooms, the earth's radius in metres.
GROUP, PHYSICAL, NODE, TRACK, PATTERN, CORRIDOR, SERVICE = "SG_", "PS_", "GN_", "TRACK_", "PATTERN_", "GEOM_CORRIDOR_", "GEOM_SERVICE_"
HUB_RANK, RANK, HUB_ZOOM, ZOOM, MOST_ZOOM = 100, 50, 4, 6, 24
DRAWN = [(CORRIDOR, "corridor", 0, 7), (SERVICE, "service_path", 7, 24)]
RADIUS = 6371000.0


class Network(NamedTuple):
    """What a bundle is made from."""

    #: (station_id, name, name_ja, name_en, hub, lat, lon)
    stations: DataFrame
    #: (route_id, name, pos, station_id): physical routes
    routes: DataFrame
    #: (service_id, line_id, short_name, long_name, color, parts): services of lines, parts being physical routes in order
    services: DataFrame
    #: (number, service_name, service_number, direction): trains, numbered in the dataset's order; None where only the lines are wanted
    trains: DataFrame | None
    #: (number, sequence, line_id, station_id, arrival, departure): minutes, one of which may be missing
    stops: DataFrame | None


def prefixed(prefix: str, column: str = "station_id") -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def category() -> Column:
    return F.when(F.col("hub"), "hub").otherwise("normal")


def rank() -> Column:
    return F.when(F.col("hub"), HUB_RANK).otherwise(RANK)


def physical_stations(n: Network) -> DataFrame:
    return n.stations.select(prefixed(PHYSICAL).alias("id"), "name", F.col("station_id").cast("string").alias("source_stop"), prefixed(GROUP).alias("group_id"), category().alias("category"), "lat", "lon")


def station_groups(n: Network) -> DataFrame:
    return n.stations.select(prefixed(GROUP).alias("id"), F.col("name").alias("primary_name"), prefixed(PHYSICAL).alias("physical_id"), "lat", "lon", category().alias("category"), rank().alias("label_rank"))


def label_representations(n: Network) -> DataFrame:
    """Stations without any name of their own get no label here."""
    named = n.stations.where("name_ja IS NOT NULL OR name_en IS NOT NULL")
    return named.select(prefixed(GROUP).alias("group_id"), F.when(F.col("hub"), HUB_ZOOM).otherwise(ZOOM).alias("min_zoom"), F.lit(MOST_ZOOM).alias("max_zoom"), rank().alias("label_rank"), "name_ja", F.coalesce("name_en", "name").alias("name_en"), "lat", "lon")


def game_nodes(n: Network) -> DataFrame:
    return n.stations.select(prefixed(NODE).alias("id"), prefixed(GROUP).alias("group_id"), category().alias("category"), F.col("name").alias("reveal_name"))


def _path(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, points, groups, path): the stations of each line in order, as ids and as places."""
    listed = F.array_sort(F.collect_list(F.struct("place", "station_id", "lon", "lat")))
    got = rows.groupBy(*keys).agg(listed.alias("l"))
    return got.select(*keys, F.size("l").alias("points"), F.array_join(F.transform("l", lambda x: F.concat(F.lit(GROUP), x["station_id"].cast("string"))), " ").alias("groups"), F.transform("l", lambda x: F.array(x["lon"], x["lat"])).alias("path"))


def track_centerlines(n: Network) -> DataFrame:
    rows = n.routes.join(n.stations.select("station_id", "lon", "lat"), "station_id").withColumn("place", F.col("pos"))
    return _path(rows, "route_id", "name").select(prefixed(TRACK, "route_id").alias("id"), F.col("name").alias("line_name"), "points", "groups", "path")


def service_routes(n: Network) -> DataFrame:
    return n.services.select(F.col("service_id").alias("id"), "short_name", "long_name", "color", F.lit("#ffffff").alias("text_color"))


def service_stations(n: Network) -> DataFrame:
    """(service_id, place, station_id): physical routes one after the other, a station that follows itself once."""
    parts = n.services.select("service_id", F.posexplode("parts").alias("part", "route_id"))
    rows = parts.join(n.routes.select("route_id", "pos", "station_id"), "route_id")
    order = Window.partitionBy("service_id").orderBy("part", "pos")
    return rows.withColumns({"last": F.lag("station_id").over(order), "place": F.row_number().over(order)}).where("last IS NULL OR last <> station_id").select("service_id", "place", "station_id")


def _service_paths(n: Network) -> DataFrame:
    return _path(service_stations(n).join(n.stations.select("station_id", "lon", "lat"), "station_id"), "service_id")


def service_patterns(n: Network) -> DataFrame:
    made = _service_paths(n).join(n.services.select("service_id", "short_name"), "service_id")
    return made.select(prefixed(PATTERN, "service_id").alias("id"), F.col("service_id").alias("route_id"), F.col("short_name").alias("label"), prefixed(SERVICE, "service_id").alias("shape_id"), "points", "groups")


def service_geometry(n: Network) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(r).alias("representation"), F.lit(a).alias("min_zoom"), F.lit(b).alias("max_zoom")) for p, r, a, b in DRAWN))
    return _service_paths(n).select("service_id", "points", "path", F.inline(kinds)).select(F.concat("prefix", "service_id").alias("id"), F.col("service_id").alias("route_id"), "representation", "min_zoom", "max_zoom", F.lit(0).alias("offset_rank"), "points", "path")


def trips(n: Network) -> DataFrame:
    """Trains whose first stop's line has a service; the others are left out, but keep their numbers."""
    line = n.stops.groupBy("number").agg(F.min_by("line_id", "sequence").alias("line_id"))
    known = n.trains.join(line, "number").join(n.services.select("line_id", "service_id"), "line_id")
    return known.select(trip_id(F.col("number")).alias("id"), "number", F.col("service_id").alias("route_id"), prefixed(PATTERN, "service_id").alias("pattern_id"), "service_name", "service_number", "direction")


def metres(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat0, lat1) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half(lon0, lon1)
    return 2 * RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def stop_times(n: Network) -> DataFrame:
    """(trip_id, sequence, group_id, physical_id, arrival_sec, departure_sec, distance): stops at known stations; a missing time is the other one, distances go from stop to stop."""
    rows = n.stops.join(trips(n).select("number", F.col("id").alias("trip_id")), "number").join(n.stations.select("station_id", "lat", "lon"), "station_id")
    order = Window.partitionBy("trip_id").orderBy("sequence")
    step = metres(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    so_far = rows.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.round(F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)), 3))
    return so_far.select("trip_id", "sequence", prefixed(GROUP).alias("group_id"), prefixed(PHYSICAL).alias("physical_id"), (F.coalesce("arrival", "departure") * 60).alias("arrival_sec"), (F.coalesce("departure", "arrival") * 60).alias("departure_sec"), "distance")


def stop_patterns(times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern_no, stops, trips, groups) of each sequence of stations that trips stop at, and (trip_id, pattern_no).

    A sequence is known by its SHA-256; numbers are dense, in the order of the digests, given range by range.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "group_id"))), lambda x: x["group_id"]), " ")
    folder = new_folder(times.sparkSession, "sequences")
    times.groupBy("trip_id").agg(listed.alias("groups"), F.count("*").alias("stops")).withColumn("digest", F.sha2(F.col("groups").cast("binary"), 256)).write.parquet(folder)
    every = times.sparkSession.read.parquet(folder)
    known = ranked(every.groupBy("digest").agg(F.first("groups").alias("groups"), F.first("stops").alias("stops"), F.count("*").alias("trips")), "digest", name="pattern_no")
    return known.select("pattern_no", "stops", "trips", "groups"), every.join(known.select("digest", "pattern_no"), "digest").select("trip_id", "pattern_no")


def pathways(n: Network) -> DataFrame:
    """No walkways between stations are known, so this one has no rows."""
    return n.stations.sparkSession.createDataFrame([], "id string, from_group_id string, to_group_id string")


#: The collections.
TABLES = {f.__name__: f for f in (physical_stations, station_groups, label_representations, game_nodes, track_centerlines, service_routes, service_patterns, service_geometry, trips, stop_times, pathways)}


def bundle(n: Network, *names: str) -> dict[str, DataFrame]:
    """The named collections, or all."""
    return {name: TABLES[name](n) for name in names or TABLES}


#: Columns that must be found in another table.
REFERENCES = [("physical_stations", "group_id", "station_groups", "id"), ("station_groups", "physical_id", "physical_stations", "id"), ("station_groups", "id", "label_representations", "group_id"), ("game_nodes", "group_id", "station_groups", "id"), ("service_patterns", "route_id", "service_routes", "id"), ("service_patterns", "shape_id", "service_geometry", "id"), ("service_routes", "id", "trips", "route_id"), ("trips", "pattern_id", "service_patterns", "id"), ("stop_times", "physical_id", "physical_stations", "id"), ("trips", "id", "stop_times", "trip_id")]


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """(reference, rows): how many values of each reference are not found, those without any too."""
    counts = []
    for table, column, other, key in REFERENCES:
        lost = tables[table].select(F.col(column).alias("v")).join(tables[other].select(F.col(key).alias("v")).distinct(), "v", "left_anti")
        counts.append(lost.agg(F.count("*").alias("rows")).select(F.lit(f"{table}.{column}").alias("reference"), "rows"))
    return union_all(*counts)


def gis_layers(tables: dict[str, DataFrame]) -> DataFrame:
    """(layer, id, geometry_type, points, name_en, name_ja, rank, color, min_zoom, max_zoom): stations with their labels, tracks, and geometry with its route.

    A station without a label keeps its own name and a common rank; a label without a Japanese name leaves it empty.
    """
    label = tables["label_representations"].select("group_id", F.struct("name_en", "name_ja", "label_rank").alias("l"))
    none = F.lit(None)
    text, number = none.cast("string"), none.cast("int")
    own = lambda c, other: F.when(F.col("l").isNull(), other).otherwise(F.col(f"l.{c}"))
    stations = tables["physical_stations"].join(label, "group_id", "left").select(F.lit("stations").alias("layer"), "id", F.lit("Point").alias("geometry_type"), F.lit(1).alias("points"), own("name_en", F.col("name")).alias("name_en"), own("name_ja", F.col("name")).alias("name_ja"), own("label_rank", F.lit(RANK)).alias("rank"), text.alias("color"), number.alias("min_zoom"), number.alias("max_zoom"))
    tracks = tables["track_centerlines"].select(F.lit("track_centerlines").alias("layer"), "id", F.lit("LineString").alias("geometry_type"), "points", F.col("line_name").alias("name_en"), text.alias("name_ja"), number.alias("rank"), text.alias("color"), number.alias("min_zoom"), number.alias("max_zoom"))
    route = tables["service_routes"].select(F.col("id").alias("route_id"), "short_name", "color")
    paths = tables["service_geometry"].join(route, "route_id").select(F.lit("service_paths").alias("layer"), "id", F.lit("LineString").alias("geometry_type"), "points", F.col("short_name").alias("name_en"), text.alias("name_ja"), F.col("offset_rank").alias("rank"), "color", "min_zoom", "max_zoom")
    return union_all(stations, tracks, paths)


def network(spark: SparkSession, sf_dir: str, running: bool = True) -> Network:
    """Suppliers are stations, but every 13th is unknown; nations are routes; a service has its nation's route and the next one's, and the last five nations have none; orders are trains that stop at their lines' suppliers."""
    k = F.col("s_suppkey")
    every = read(spark, sf_dir, "supplier").where(k % 13 != 0)
    stations = every.select(k.alias("station_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("駅"), k.cast("string"))).alias("name_ja"), F.when(k % 4 > 0, F.lower("s_name")).alias("name_en"), (k % 10 == 0).alias("hub"), (31.0 + (k * 7 % 31) * 0.5).alias("lat"), (128.0 + (k % 37) * 0.5).alias("lon"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_name").alias("name"))
    routes = every.join(nation, F.col("s_nationkey") == F.col("route_id")).select("route_id", "name", k.alias("pos"), k.alias("station_id"))
    r = F.col("route_id")
    services = nation.where("route_id < 20").select(F.concat(F.lit("SR"), r.cast("string")).alias("service_id"), r.alias("line_id"), F.initcap("name").alias("short_name"), F.concat(F.initcap("name"), F.lit(" Service")).alias("long_name"), F.format_string("#%06x", (r * 40503 % 16777216).cast("int")).alias("color"), F.array(r, r + 1).alias("parts"))
    if not running:
        return Network(stations, routes, services, None, None)
    # lines of an order may have one number
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("place"), "l_suppkey")
    number = ranked(lines.select("l_orderkey").distinct(), "l_orderkey", name="number")
    trains = number.select("number", F.element_at(F.array(F.lit("Nozomi"), F.lit("Hikari"), F.lit("Kodama")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("service_name"), F.col("l_orderkey").cast("string").alias("service_number"), F.when(F.col("l_orderkey") % 2 == 0, "outbound").otherwise("inbound").alias("direction"))
    o, l = F.col("l_orderkey"), F.col("place")
    line = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("line_id"))
    minute = ((o * 7 + l * 11) % 1440).cast("int")
    stops = lines.join(number, "l_orderkey").select("number", F.col("place").alias("sequence"), F.col("l_suppkey").alias("station_id"), F.when(l % 5 != 1, minute).alias("arrival"), F.when(l % 5 != 2, minute + 1).alias("departure")).join(line, "station_id")
    return Network(stations, routes, services, trains, stops)


def _table(name: str, *without: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bundle(network(spark, sf_dir, name in ("trips", "stop_times")), name)[name].drop(*without)

    return query


QUERIES = {
    **{f"bundle_{n}": _table(n, "path", "number") for n in ("physical_stations", "station_groups", "label_representations", "game_nodes", "track_centerlines", "service_routes", "service_patterns", "service_geometry", "trips", "stop_times")},
    "bundle_stop_patterns": lambda spark, sf_dir: stop_patterns(stop_times(network(spark, sf_dir)))[0],
    "bundle_dangling": lambda spark, sf_dir: dangling(bundle(network(spark, sf_dir))),
    "gis_layers": lambda spark, sf_dir: gis_layers(bundle(network(spark, sf_dir, False), "physical_stations", "label_representations", "track_centerlines", "service_routes", "service_geometry")),
}

_S = """s AS (SELECT s_suppkey AS k, s_nationkey AS r, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '駅' || s_suppkey END AS ja, CASE WHEN s_suppkey % 4 > 0 THEN lower(s_name) END AS en, s_suppkey % 10 = 0 AS hub,
  CASE WHEN s_suppkey % 10 = 0 THEN 'hub' ELSE 'normal' END AS category, CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 50 END AS rank, 31.0::DOUBLE + s_suppkey * 7 % 31 * 0.5 AS lat, 128.0::DOUBLE + s_suppkey % 37 * 0.5 AS lon FROM supplier WHERE s_suppkey % 13 <> 0),
w AS (SELECT n_nationkey AS r, 'SR' || n_nationkey AS id, upper(n_name[1]) || lower(n_name[2:]) AS short FROM nation WHERE n_nationkey < 20),
p AS (SELECT w.id, w.r, w.short, list('SG_' || k ORDER BY s.r, k) AS g FROM w JOIN s ON s.r IN (w.r, w.r + 1) GROUP BY ALL),
d AS (SELECT l_orderkey AS o, dense_rank() OVER (ORDER BY l_orderkey) AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS l, l_suppkey AS k, s_nationkey AS line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
t AS (SELECT o, number, 'TRIP_' || CASE WHEN number < 100000 THEN lpad(number::VARCHAR, 5, '0') ELSE number::VARCHAR END AS id, arg_min(line, l) AS line FROM d GROUP BY o, number HAVING arg_min(line, l) < 20),
e AS (SELECT t.id, l, k, (o * 7 + l * 11) % 1440 AS m, lat, lon, lag(lat) OVER v AS lat0, lag(lon) OVER v AS lon0 FROM d JOIN t USING (o, number) JOIN s USING (k) WINDOW v AS (PARTITION BY t.id ORDER BY l)),
h AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2) AS h FROM e),
c AS (SELECT id, 'SG_' || k AS g, l FROM e)"""
ORACLE = {
    "bundle_physical_stations": f"WITH {_S} SELECT 'PS_' || k AS id, name, k::VARCHAR AS source_stop, 'SG_' || k AS group_id, category, lat, lon FROM s",
    "bundle_station_groups": f"WITH {_S} SELECT 'SG_' || k AS id, name AS primary_name, 'PS_' || k AS physical_id, lat, lon, category, rank AS label_rank FROM s",
    "bundle_label_representations": f"WITH {_S} SELECT 'SG_' || k AS group_id, CASE WHEN hub THEN 4 ELSE 6 END AS min_zoom, 24 AS max_zoom, rank AS label_rank, ja AS name_ja, coalesce(en, name) AS name_en, lat, lon FROM s WHERE NOT (ja IS NULL AND en IS NULL)",
    "bundle_game_nodes": f"WITH {_S} SELECT 'GN_' || k AS id, 'SG_' || k AS group_id, category, name AS reveal_name FROM s",
    "bundle_track_centerlines": f"WITH {_S} SELECT 'TRACK_' || r AS id, n_name AS line_name, count(*)::INTEGER AS points, string_agg('SG_' || k, ' ' ORDER BY k) AS groups FROM s JOIN nation ON n_nationkey = r GROUP BY r, n_name",
    "bundle_service_routes": f"WITH {_S} SELECT id, short AS short_name, short || ' Service' AS long_name, '#' || lower(lpad(to_hex(r * 40503 % 16777216), 6, '0')) AS color, '#ffffff' AS text_color FROM w",
    "bundle_service_patterns": f"WITH {_S} SELECT 'PATTERN_' || id AS id, id AS route_id, short AS label, 'GEOM_SERVICE_' || id AS shape_id, len(g)::INTEGER AS points, array_to_string(g, ' ') AS groups FROM p",
    "bundle_service_geometry": f"WITH {_S} SELECT 'GEOM_CORRIDOR_' || id AS id, id AS route_id, 'corridor' AS representation, 0 AS min_zoom, 7 AS max_zoom, 0 AS offset_rank, len(g)::INTEGER AS points FROM p UNION ALL SELECT 'GEOM_SERVICE_' || id, id, 'service_path', 7, 24, 0, len(g) FROM p",
    "bundle_trips": f"WITH {_S} SELECT id, 'SR' || line AS route_id, 'PATTERN_SR' || line AS pattern_id, CASE o % 3 WHEN 0 THEN 'Nozomi' WHEN 1 THEN 'Hikari' ELSE 'Kodama' END AS service_name, o::VARCHAR AS service_number, CASE o % 2 WHEN 0 THEN 'outbound' ELSE 'inbound' END AS direction FROM t",
    "bundle_stop_times": f"""WITH {_S} SELECT id AS trip_id, l::INTEGER AS sequence, 'SG_' || k AS group_id, 'PS_' || k AS physical_id, CAST(CASE WHEN l % 5 = 1 THEN m + 1 ELSE m END * 60 AS INTEGER) AS arrival_sec, CAST(CASE WHEN l % 5 = 2 THEN m ELSE m + 1 END * 60 AS INTEGER) AS departure_sec,
  round(sum(coalesce(2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)), 0)) OVER (PARTITION BY id ORDER BY l), 3) AS distance FROM h""",
    "bundle_stop_patterns": f"WITH {_S}, q AS (SELECT id, string_agg(g, ' ' ORDER BY l) AS groups, count(*) AS stops FROM c GROUP BY id) SELECT row_number() OVER (ORDER BY sha256(groups)) AS pattern_no, stops, count(*) AS trips, groups FROM q GROUP BY groups, stops",
    "bundle_dangling": f"""WITH {_S}, z AS (SELECT unnest(['physical_stations.group_id', 'station_groups.physical_id', 'game_nodes.group_id', 'service_patterns.route_id', 'service_patterns.shape_id', 'stop_times.physical_id']) AS reference)
SELECT reference, 0::BIGINT AS rows FROM z UNION ALL SELECT 'station_groups.id', count(*) FROM s WHERE ja IS NULL AND en IS NULL UNION ALL SELECT 'service_routes.id', count(*) FROM w WHERE r NOT IN (SELECT line FROM t)
UNION ALL SELECT 'trips.pattern_id', count(*) FROM t WHERE 'SR' || line NOT IN (SELECT id FROM p) UNION ALL SELECT 'trips.id', count(*) FROM t WHERE id NOT IN (SELECT id FROM e)""",
    "gis_layers": f"""WITH {_S} SELECT 'stations' AS layer, 'PS_' || k AS id, 'Point' AS geometry_type, 1 AS points, CASE WHEN ja IS NULL AND en IS NULL THEN name ELSE coalesce(en, name) END AS name_en, CASE WHEN ja IS NULL AND en IS NULL THEN name ELSE ja END AS name_ja, CASE WHEN ja IS NULL AND en IS NULL THEN 50 ELSE rank END AS rank, NULL AS color, NULL::INTEGER AS min_zoom, NULL::INTEGER AS max_zoom FROM s
UNION ALL SELECT 'track_centerlines', 'TRACK_' || r, 'LineString', count(*), n_name, NULL, NULL, NULL, NULL, NULL FROM s JOIN nation ON n_nationkey = r GROUP BY r, n_name
UNION ALL SELECT 'service_paths', x || id, 'LineString', len(g), short, NULL, 0, '#' || lower(lpad(to_hex(r * 40503 % 16777216), 6, '0')), a, b FROM p, (VALUES ('GEOM_CORRIDOR_', 0, 7), ('GEOM_SERVICE_', 7, 24)) y(x, a, b)""",
}
