"""Map layers and pictures of trips: features, tiles, positions on legs, diagrams, labels, and missing coordinates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.sources.adapters import SQL, points, read, stop_times
from loomrail.sources.documents import Documents, nested, read_trains, union_all, write_layers, write_tiles, write_trains, write_whole
from loomrail.sources.storage import in_blocks, new_folder, ranked, shared_folder

HUB_RANK, RANK, HUB_ZOOM, ZOOM = 100, 50, 4, 6
#: Places of routes in a block, as far as whole routes allow; tables after which they are put together in one.
PLACES, COMPACT = 50_000, 8


def _xy(station: Column) -> tuple[Column, Column]:
    """Made-up coordinates of the driver's stations, which have none."""
    return 128.0 + station * 0.5, 31.0 + (station * 7 % 25) * 0.5


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, name, hub, lon, lat, shown, rank): shown and rank are a label's and may be missing."""
    k = F.col("n_nationkey")
    lon, lat = _xy(k)
    return read(spark, sf_dir, "nation").select(k.alias("station_id"), F.col("n_name").alias("name"), (k % 4 == 0).alias("hub"), F.when(k % 9 != 8, lon).alias("lon"), F.when(k % 9 != 8, lat).alias("lat"), F.when(k % 3 > 0, F.lower("n_name")).alias("shown"), F.when(k % 3 > 0, F.when(k % 4 == 0, HUB_RANK).otherwise(RANK)).alias("rank"))


def layers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(layer, id, geometry_type, points, min_lon, min_lat, max_lon, max_lat, name, rank, min_zoom, coordinates) of stations with a place and of lines of two points or more.

    lines: (line_id, pos, lon, lat, offset). Names and ranks without a label come from the station, min_zoom
    from whether it is a hub; a line's rank is its offset, 0 where it has none.
    """
    at = F.array("lon", "lat")
    places = rows.where("lon is not null and lat is not null").select(
        F.lit("stations").alias("layer"), F.col("station_id").cast("long").alias("id"), F.lit("Point").alias("geometry_type"), F.lit(1).cast("long").alias("points"),
        F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"), F.col("lon").alias("max_lon"), F.col("lat").alias("max_lat"),
        F.coalesce("shown", "name").alias("name"), F.coalesce("rank", F.lit(RANK)).cast("long").alias("rank"), F.when(F.col("hub"), HUB_ZOOM).otherwise(ZOOM).cast("long").alias("min_zoom"), F.to_json(at).alias("coordinates"))
    drawn = lines.groupBy("line_id").agg(F.count("*").alias("points"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lon", "lat")), F.max("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("path")).where("points >= 2")
    paths = drawn.select(
        F.lit("lines").alias("layer"), F.col("line_id").cast("long").alias("id"), F.lit("LineString").alias("geometry_type"), "points", "min_lon", "min_lat", "max_lon", "max_lat",
        F.concat(F.lit("line "), F.col("line_id").cast("string")).alias("name"), F.coalesce("offset", F.lit(0)).cast("long").alias("rank"), F.lit(ZOOM).cast("long").alias("min_zoom"), F.to_json(F.transform("path", lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))
    return places.unionByName(paths)


def features(rows: DataFrame) -> DataFrame:
    """(layer, id, feature): each row of layers as GeoJSON, lines with their box."""
    box = F.when(F.col("points") > 1, F.to_json(F.array("min_lon", "min_lat", "max_lon", "max_lat")))
    properties = F.to_json(F.struct("id", "name", "rank", "min_zoom"))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.coalesce(F.concat(F.lit(',"bbox":'), box), F.lit("")), F.lit(',"geometry":{"type":"'), "geometry_type", F.lit('","coordinates":'), "coordinates", F.lit('},"properties":'), properties, F.lit("}"))
    return rows.select("layer", "id", text.alias("feature"))


def leg_positions(visits: DataFrame, minutes: list[int]) -> DataFrame:
    """(trip_id, at_minute, x, y, nearer, next): where each trip is on its first leg that holds the minute, and the nearer and the next stop of it.

    Legs of no length count as one minute long for x and y, and a position of half the way or more is nearer to the next stop.
    """
    order = Window.partitionBy("trip_id").orderBy("seq")
    legs = visits.withColumns({"to": F.lead("station_id").over(order), "arr": F.lead("minute").over(order)}).where("to is not null")
    at = legs.withColumn("at_minute", F.explode(F.array(*map(F.lit, minutes)))).where("dep <= at_minute and at_minute <= arr")
    first = at.groupBy("trip_id", "at_minute").agg(F.min(F.struct("seq", "station_id", "to", "dep", "arr")).alias("l")).select("trip_id", "at_minute", "l.*")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at_minute") - F.col("dep")) / F.greatest(F.lit(1), F.col("arr") - F.col("dep"))))
    (x0, y0), (x1, y1) = _xy(F.col("station_id")), _xy(F.col("to"))
    return first.select("trip_id", "at_minute", F.round(x0 + (x1 - x0) * share, 6).alias("x"), F.round(y0 + (y1 - y0) * share, 6).alias("y"), F.when(share >= 0.5, F.col("to")).otherwise(F.col("station_id")).alias("nearer"), F.col("to").alias("next"))


def diagram_points(visits: DataFrame, count: int, hour_width: float = 60.0, gap: float = 20.0, left: float = 100.0, top: float = 40.0) -> DataFrame:
    """(trip_id, seq, x, y): time to the right, stations downwards; a step between the last and the first station goes on beyond the edge."""
    order = Window.partitionBy("trip_id").orderBy("seq")
    before = F.lag("station_id").over(order)
    turn = F.when((F.col("station_id") == 0) & (before == count - 1), 1).when((F.col("station_id") == count - 1) & (before == 0), -1).otherwise(0)
    start = visits.agg(F.min("minute").alias("start"))
    turned = visits.withColumn("turn", turn).crossJoin(start)
    y = top + F.col("station_id") * gap + F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)) * count * gap
    return turned.select("trip_id", "seq", F.round(left + (F.col("minute") - F.col("start")) / 60 * hour_width, 4).alias("x"), F.round(y, 4).alias("y"))


def _walked(whole: bool):
    """Function of a block's rows (block, route_id, pos, station_id, lat, lon, first, outer) that goes over its routes in order.

    Routes whose missing stations are nowhere else are gone over until nothing changes, if `whole`; the
    others once, as far as none waits for an earlier one of another block. Returns what it found, the
    routes that have to wait, and those to go over again.
    """

    def walk(block: pa.Table) -> pa.Table:
        routes, known, far, held, out = {}, {}, set(), set(), []
        for r, p, s, lat, lon, first, outer, own in zip(*(block.column(c).to_pylist() for c in ("route_id", "pos", "station_id", "lat", "lon", "first", "outer", "block"))):
            routes.setdefault(r, []).append((p, s))
            if lat is not None:
                known[s] = lat, lon
            elif outer or not whole:
                far.add(s)
                if first < own:
                    held.add(s)
        order = sorted(routes)
        for stops in routes.values():
            stops.sort()
        boss, met = {r: r for r in order}, {}

        def top(r):
            while boss[r] != r:
                boss[r] = r = boss[boss[r]]
            return r

        def gaps(r):
            return [s for _, s in routes[r] if s not in known]

        def fill(r):
            """The route's missing stations between two that were known before it."""
            a, between, new = None, [], {}
            for q, s in routes[r]:
                if s not in known:
                    between.append((q, s))
                    continue
                b = q, *known[s]
                if a:
                    new.update({t: tuple(a[i] + (b[i] - a[i]) * ((k - a[0]) / (b[0] - a[0])) for i in (1, 2)) for k, t in between})
                a, between = b, []
            known.update(new)
            return new

        for r in order:
            for s in gaps(r):
                boss[top(r)] = top(met.setdefault(s, r))
        shared = {top(met[s]) for s in far}
        inner = [r for r in order if top(r) not in shared and gaps(r)]
        changed = True
        while changed:
            changed = False
            for r in inner:
                new = fill(r)
                out += [("inner", None, s, *at) for s, at in new.items()]
                changed = changed or bool(new)
            inner = [r for r in inner if gaps(r)]
        for r in order:
            if top(r) in shared and (mine := gaps(r)):
                if held.isdisjoint(mine):
                    out += [("found", None, s, *at) for s, at in fill(r).items()]
                    out += [("again", r, None, None, None)] * bool(gaps(r))
                else:
                    held.update(mine)
                    out.append(("waits", r, None, None, None))
        types = pa.string(), block.schema.field("route_id").type, block.schema.field("station_id").type, pa.float64(), pa.float64()
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], ["kind", "route_id", "station_id", "nlat", "nlon"])

    return walk


def estimated(stations: DataFrame, routes: DataFrame) -> DataFrame:
    """(station_id, lat, lon, estimated): missing coordinates between two known ones of a route, by places between them.

    routes: (route_id, pos, station_id), each station once in a route. The result is that of passes over
    the routes in order, as what one fills another may build on, until a pass fills nothing. Routes are
    dealt in order to blocks of bounded size. Those that share no missing station with another block, not
    even by way of others, are finished in their block at once; the others go through one pass in a few
    steps, in which a route waits only for earlier ones of other blocks, and are dealt to fewer blocks for
    the next. So rounds grow with the blocks that a chain of routes runs through, not with its length.
    """
    shared_folder(stations.sparkSession)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    at = stations.select("station_id", *(F.when(known, F.col(c).cast("double")).alias(c) for c in ("lat", "lon")))
    rest = routes.select("route_id", "pos", "station_id").dropna().join(at, "station_id").checkpoint()
    schema = f"kind string, route_id {rest.schema['route_id'].dataType.simpleString()}, station_id {rest.schema['station_id'].dataType.simpleString()}, nlat double, nlon double"
    filled = []

    def better(rows: DataFrame, new: DataFrame) -> DataFrame:
        return rows.join(new, "station_id", "left").select(*(c for c in rows.columns if c not in ("lat", "lon")), F.coalesce("lat", "nlat").alias("lat"), F.coalesce("lon", "nlon").alias("lon"))

    def compact(tables: list[DataFrame]) -> list[DataFrame]:
        return tables if len(tables) < COMPACT else [union_all(*tables).coalesce(at.sparkSession.sparkContext.defaultParallelism).checkpoint()]

    while not rest.isEmpty():
        dealt = in_blocks(rest, PLACES, "route_id").checkpoint()
        steps, rows, kinds, seen = [], dealt, {"waits": 1}, set()
        while "waits" in kinds:
            ends = rows.where("lat is null").groupBy("station_id").agg(F.min("block").alias("first"), (F.min("block") != F.max("block")).alias("outer"))
            got = rows.join(ends, "station_id", "left").groupBy("block").applyInArrow(_walked(not steps), schema).checkpoint()
            kinds = {r["kind"] for r in got.select("kind").distinct().collect()}
            steps, seen = compact([*steps, got]), seen | kinds
            if "waits" in kinds:
                rows = better(rows.join(got.where("kind = 'waits'").select("route_id"), "route_id", "left_semi"), _found(got)).checkpoint()
        new = _found(union_all(*steps))
        filled = compact([*filled, new])
        if not {"found", "again"} <= seen:
            break
        again = union_all(*steps).where("kind = 'again'").select("route_id")
        rest = better(dealt.drop("block").join(again, "route_id", "left_semi"), new).checkpoint()
    found = union_all(*filled) if filled else at.select("station_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon")).where("false")
    return stations.select("station_id", "lat", "lon").join(found, "station_id", "left").select("station_id", F.coalesce("nlat", "lat").alias("lat"), F.coalesce("nlon", "lon").alias("lon"), F.col("nlat").isNotNull().alias("estimated"))


def _found(got: DataFrame) -> DataFrame:
    return got.where("station_id is not null").select("station_id", "nlat", "nlon")


def label_overlaps(rows: DataFrame, wide: float = 0.3, high: float = 0.1) -> DataFrame:
    """(point_id, overlaps): other boxes that each label's box meets; a box looks into every cell that it reaches, so none is lost at an edge."""
    cell = lambda c: F.floor(c).cast("long")
    own = rows.select("point_id", "lon", "lat", cell(F.col("lon")).alias("cx"), cell(F.col("lat")).alias("cy"))
    reach = lambda c, r: F.explode(F.sequence(cell(F.col(c) - r), cell(F.col(c) + r)))
    other = rows.select(F.col("point_id").alias("o"), F.col("lon").alias("olon"), F.col("lat").alias("olat"), reach("lon", wide).alias("cx")).select("*", F.explode(F.sequence(cell(F.col("olat") - high), cell(F.col("olat") + high))).alias("cy"))
    met = own.join(other, ["cx", "cy"]).where((F.col("point_id") != F.col("o")) & (F.abs(F.col("lon") - F.col("olon")) < wide) & (F.abs(F.col("lat") - F.col("olat")) < high))
    counts = met.groupBy("point_id").agg(F.count("*").alias("overlaps"))
    return rows.select("point_id").join(counts, "point_id", "left").select("point_id", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_times(read(spark, sf_dir, "events"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = points(read(spark, sf_dir, "embeddings")).select((F.col("point_id") % 40).alias("line_id"), F.col("point_id").alias("pos"), "lon", "lat", F.when(F.col("point_id") % 40 % 3 > 0, F.col("point_id") % 40).alias("offset"))
    return layers(stations(spark, sf_dir), lines)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.round(F.col(c), 5).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    return _layers(spark, sf_dir).select("layer", "id", "geometry_type", "points", *box, "name", "rank", "min_zoom")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_layers(features(_layers(spark, sf_dir)), new_folder(spark, "layers"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = points(read(spark, sf_dir, "embeddings"))
    at = [pt.select(F.lit("points").alias("layer"), F.lit(z).alias("z"), *(F.least(F.greatest(F.floor(v * 2**z).cast("int"), F.lit(0)), F.lit(2**z - 1)).alias(c) for c, v in (("x", (F.col("lon") - 128.0) / 18.5), ("y", (46.5 - F.col("lat")) / 16.5))), F.col("point_id").cast("string").alias("feature")) for z in (1, 2, 3)]
    return write_tiles(union_all(*at), new_folder(spark, "tiles"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "documents")
    write_trains(_visits(spark, sf_dir).select("trip_id", "seq", "station_id", "minute", "dep"), path)
    return read_trains(spark, path, STOP, "lines").rows.drop("path")


STOP = "seq bigint, station_id int, minute int, dep int"
#: Trips in one whole document.
BLOCK = 20


def _whole(spark: SparkSession, sf_dir: str) -> Documents:
    """Visits written as whole documents, every seventh of them broken, and read again."""
    path = new_folder(spark, "whole")
    stops = _visits(spark, sf_dir).select("trip_id", "seq", "station_id", "minute", "dep", F.floor(F.col("trip_id") / BLOCK).alias("block"))
    write_whole(nested(stops, "block"), path, "block", F.col("block") % 7 == 3)
    return read_trains(spark, path, STOP)


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).rejected.select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("long").alias("block"), "reason")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stations(spark, sf_dir).where(f"rank >= {RANK} and lon is not null and lat is not null")
    return ranked(rows.select((-F.col("rank")).alias("below"), "name"), "below", "name", name="pos").select("pos", "name", (-F.col("below")).alias("rank"))


def _catchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, trip_id, seq, dep): each trip's first visit of a station from minute 600 on."""
    first = _visits(spark, sf_dir).where("dep >= 600").groupBy("station_id", "trip_id").agg(F.min(F.struct("seq", "dep")).alias("v"))
    return first.select("station_id", "trip_id", "v.seq", "v.dep")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("Line "), (F.col("trip_id") % 13).cast("string"))
    order = Window.partitionBy("station_id").orderBy("dep", "label", "trip_id")
    return _catchable(spark, sf_dir).withColumn("label", label).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 100").select("station_id", "rank", "dep", "label", "trip_id")


def _six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six trips that can be caught at each station, in the dataset's order, which is that of their first records."""
    place = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trip_id")).agg(F.min("event_id").alias("place"))
    order = Window.partitionBy("station_id").orderBy("place")
    return _catchable(spark, sf_dir).join(place, "trip_id").withColumn("option", F.row_number().over(order).cast("long")).where("option <= 6").select("station_id", "option", "trip_id", "dep")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six stops after each stop; with the ride that ends at the next later visit of station 3, if there is one."""
    after = Window.partitionBy("trip_id").orderBy("seq")
    following = F.array_join(F.collect_list(F.col("station_id").cast("string")).over(after.rowsBetween(1, 6)), ">")
    off = F.min(F.when(F.col("station_id") == 3, F.col("seq"))).over(after.rowsBetween(1, Window.unboundedFollowing))
    return _visits(spark, sf_dir).select("trip_id", "seq", following.alias("preview"), F.coalesce(off, F.lit(-1)).alias("alight_seq"))


def _raw_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up as they are among normalised keys: only names that are normal already are found."""
    from loomrail.functions import normal_name

    keys = read(spark, sf_dir, "nation").select(normal_name(F.col("n_name")).alias("key"), F.col("n_nationkey").alias("station_id"))
    raw = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, normal_name(F.col("n_name"))).otherwise(F.col("n_name")).alias("key"))
    return raw.join(keys, "key").select("s_suppkey", "station_id")


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = stations(spark, sf_dir)
    k = F.col("station_id")
    sparse = nation.select("station_id", F.when(k % 4 == 0, F.col("lat")).alias("lat"), F.when(k % 4 == 0, F.col("lon")).alias("lon"))
    routes = nation.select(F.explode(F.array((k % 5), 5 + (k % 3))).alias("route_id"), k.alias("pos"), "station_id")
    return estimated(sparse, routes).select("station_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "estimated")


def _estimated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stations: each route has twelve in a row, of which it shares the last four with the next; some stretches of them have no coordinates."""
    k = F.col("p_partkey")
    h = F.crc32(k.cast("string").cast("binary")) % 10
    lost = (h < 4) | ((F.floor(k / 6) % 5) == 2)
    rows = read(spark, sf_dir, "part").select(k.alias("station_id"), F.when(~lost, 31.0 + (k * 7 % 25) * 0.5).alias("lat"), F.when(~lost, 128.0 + k % 97 * 0.25).alias("lon"))
    routes = rows.select(F.explode(F.sequence(F.floor((F.col("station_id") - 4) / 8), F.floor(F.col("station_id") / 8))).alias("route_id"), F.col("station_id").alias("pos"), "station_id")
    return estimated(rows, routes).select("station_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "estimated")


QUERIES = {
    "map_layers": _shown,
    "layer_manifest": _manifest,
    "tile_manifest": _tiles,
    "train_documents_roundtrip": _documents,
    "train_documents_whole": lambda spark, sf_dir: _whole(spark, sf_dir).rows.drop("path"),
    "train_documents_rejected": _rejected,
    "leg_positions": lambda spark, sf_dir: leg_positions(_visits(spark, sf_dir), [600, 5000, 20000]),
    "diagram_points": lambda spark, sf_dir: diagram_points(_visits(spark, sf_dir), 25),
    "label_overlap_scores": lambda spark, sf_dir: label_overlaps(points(read(spark, sf_dir, "embeddings"))),
    "label_order": _labels,
    "departures_top100": _top,
    "options_first_six": _six,
    "downstream_preview": _preview,
    "raw_name_lookup": _raw_lookup,
    "estimated_coordinates": _estimated,
    "estimated_route_coordinates": _estimated_parts,
}

_S = "(SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 9 <> 8 THEN 128.0 + n_nationkey * 0.5 END AS lon, CASE WHEN n_nationkey % 9 <> 8 THEN 31.0 + n_nationkey * 7 % 25 * 0.5 END AS lat FROM nation)"
_C = f"(SELECT station_id, trip_id, min(seq) AS seq, arg_min(dep, seq) AS dep FROM {SQL['st']} WHERE dep >= 600 GROUP BY 1, 2)"
ORACLE = {
    "map_layers": f"""
SELECT 'stations' AS layer, CAST(k AS BIGINT) AS id, 'Point' AS geometry_type, CAST(1 AS BIGINT) AS points, CAST(lon AS DOUBLE) AS min_lon, CAST(lat AS DOUBLE) AS min_lat, CAST(lon AS DOUBLE) AS max_lon, CAST(lat AS DOUBLE) AS max_lat, CASE WHEN k % 3 > 0 THEN lower(n_name) ELSE n_name END AS name,
       CAST(CASE WHEN k % 3 > 0 AND k % 4 = 0 THEN 100 ELSE 50 END AS BIGINT) AS rank, CAST(CASE WHEN k % 4 = 0 THEN 4 ELSE 6 END AS BIGINT) AS min_zoom FROM {_S} WHERE lon IS NOT NULL
UNION ALL SELECT 'lines', point_id % 40, 'LineString', count(*), round(min(lon), 5), round(min(lat), 5), round(max(lon), 5), round(max(lat), 5), 'line ' || (point_id % 40), CASE WHEN point_id % 40 % 3 > 0 THEN point_id % 40 ELSE 0 END, 6 FROM {SQL['pt']} GROUP BY point_id % 40 HAVING count(*) > 1""",
    "layer_manifest": f"SELECT 'stations' AS layer, count(*) AS features, 'Point' AS geometry_type FROM nation WHERE n_nationkey % 9 <> 8 UNION ALL SELECT 'lines', count(*), 'LineString' FROM (SELECT vec_id % 40 FROM embeddings GROUP BY 1 HAVING count(*) > 1)",
    "tile_manifest": f"SELECT 'points' AS layer, z, count(DISTINCT x * 1000 + y) AS tiles, count(*) AS features FROM (SELECT z, least(greatest(floor((lon - 128.0) / 18.5 * 2**z), 0), 2**z - 1) AS x, least(greatest(floor((46.5 - lat) / 16.5 * 2**z), 0), 2**z - 1) AS y FROM {SQL['pt']} CROSS JOIN (VALUES (1), (2), (3)) v(z)) GROUP BY z",
    "train_documents_roundtrip": f"SELECT CAST(trip_id AS VARCHAR) AS train_number, seq, station_id, minute, dep FROM {SQL['st']}",
    "train_documents_whole": f"SELECT CAST(trip_id AS VARCHAR) AS train_number, seq, station_id, minute, dep FROM {SQL['st']} WHERE trip_id // 20 % 7 <> 3",
    "train_documents_rejected": f"SELECT DISTINCT trip_id // 20 AS block, 'broken' AS reason FROM {SQL['st']} WHERE trip_id // 20 % 7 = 3",
    "leg_positions": f"""
WITH v AS (SELECT * FROM {SQL['st']}), l AS (SELECT a.trip_id, a.seq, t AS at_minute, a.station_id AS f, b.station_id AS n, CASE WHEN b.minute = a.dep THEN CAST(t - a.dep AS DOUBLE) ELSE (t - a.dep) / (b.minute - a.dep) END AS s FROM v a JOIN v b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 JOIN (VALUES (600), (5000), (20000)) w(t) ON t BETWEEN a.dep AND b.minute),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY trip_id, at_minute ORDER BY seq) = 1)
SELECT trip_id, at_minute, round(128.0 + (f + (n - f) * s) * 0.5, 6) AS x, round(31.0 + (f * 7 % 25 + (n * 7 % 25 - f * 7 % 25) * s) * 0.5, 6) AS y, CASE WHEN s < 0.5 THEN f ELSE n END AS nearer, n AS next FROM o""",
    "diagram_points": f"""
WITH v AS (SELECT * FROM {SQL['st']}), e AS (SELECT a.trip_id, a.seq, CASE WHEN a.station_id = 0 AND b.station_id = 24 THEN 1 WHEN a.station_id = 24 AND b.station_id = 0 THEN -1 END AS d FROM v a JOIN v b ON b.trip_id = a.trip_id AND b.seq = a.seq - 1)
SELECT trip_id, seq, round(100.0 + minute - (SELECT min(minute) FROM v), 4) AS x, round(40.0 + 20.0 * station_id + 500.0 * coalesce((SELECT sum(d) FROM e WHERE e.trip_id = v.trip_id AND e.seq <= v.seq), 0), 4) AS y FROM v""",
    "label_overlap_scores": f"WITH p AS (SELECT * FROM {SQL['pt']}) SELECT a.point_id, count(b.point_id) AS overlaps FROM p a LEFT JOIN p b ON a.point_id <> b.point_id AND abs(a.lon - b.lon) < 0.3 AND abs(a.lat - b.lat) < 0.1 GROUP BY a.point_id",
    "label_order": f"SELECT row_number() OVER (ORDER BY CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END, n_name) AS pos, n_name AS name, CASE WHEN k % 4 = 0 THEN 100 ELSE 50 END AS rank FROM {_S} WHERE k % 3 > 0 AND lon IS NOT NULL",
    "departures_top100": f"SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY dep, 'Line ' || (trip_id % 13), trip_id) AS rank, dep, 'Line ' || (trip_id % 13) AS label, trip_id FROM {_C} QUALIFY rank <= 100",
    "options_first_six": f"""
WITH c AS (SELECT c.*, e.place FROM {_C} c JOIN (SELECT user_id, min(event_id) AS place FROM events GROUP BY 1) e ON user_id = trip_id)
SELECT station_id, 1 + (SELECT count(*) FROM c o WHERE o.station_id = c.station_id AND o.place < c.place) AS option, trip_id, dep FROM c WHERE (SELECT count(*) FROM c o WHERE o.station_id = c.station_id AND o.place < c.place) < 6""",
    "downstream_preview": f"""
WITH v AS (SELECT * FROM {SQL['st']}) SELECT trip_id, seq, coalesce((SELECT string_agg(CAST(o.station_id AS VARCHAR), '>' ORDER BY o.seq) FROM v o WHERE o.trip_id = v.trip_id AND o.seq BETWEEN v.seq + 1 AND v.seq + 6), '') AS preview,
  coalesce((SELECT min(o.seq) FROM v o WHERE o.trip_id = v.trip_id AND o.seq > v.seq AND o.station_id = 3), -1) AS alight_seq FROM v""",
    "raw_name_lookup": "SELECT s_suppkey, s_nationkey AS station_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0 OR regexp_matches(n_name, '^[a-z]+$')",
}
