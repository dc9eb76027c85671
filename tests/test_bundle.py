"""The linked tables of a network made by hand."""

import math

import pytest

from loomrail.operators import bundle


@pytest.fixture(scope="module")
def small(spark):
    stations = spark.createDataFrame([(1, "A", "あ", "a", True, 35.0, 139.0), (2, "B", None, None, False, 35.1, 139.0), (3, "C", None, "c", False, 35.1, 139.2)], "station_id long, name string, name_ja string, name_en string, hub boolean, lat double, lon double")
    routes = spark.createDataFrame([(7, "North", 1, 1), (7, "North", 2, 2), (8, "East", 1, 2), (8, "East", 2, 3), (8, "East", 3, 99)], "route_id long, name string, pos long, station_id long")
    services = spark.createDataFrame([("SR1", 5, "Ex", "Express", "#123456", [7, 8]), ("SR2", 6, "Lo", "Local", "#000000", [8])], "service_id string, line_id long, short_name string, long_name string, color string, parts array<long>")
    trains = spark.createDataFrame([(1, "N", "1", "out"), (2, "N", "2", "out"), (3, "N", "3", "in"), (123456, "N", "4", "in")], "number long, service_name string, service_number string, direction string")
    stops = spark.createDataFrame([(1, 1, 5, 1, None, 60), (1, 2, 5, 98, 61, 62), (1, 3, 6, 3, 70, None), (2, 1, 4, 1, 5, 6), (3, 1, 5, 1, 9, 10), (3, 4, 5, 3, 20, 21), (123456, 1, 6, 98, 1, 2)], "number long, sequence int, line_id long, station_id long, arrival int, departure int")
    return bundle.Network(stations, routes, services, trains, stops)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_stations_and_lines(small):
    got = bundle.bundle(small)
    assert len(got) == 11 and got["pathways"].count() == 0
    assert rows(got["station_groups"], "id", "physical_id", "category", "label_rank") == [("SG_1", "PS_1", "hub", 100), ("SG_2", "PS_2", "normal", 50), ("SG_3", "PS_3", "normal", 50)]
    assert rows(got["label_representations"], "group_id", "min_zoom", "max_zoom", "name_en") == [("SG_1", 4, 24, "a"), ("SG_3", 6, 24, "c")]
    assert rows(got["track_centerlines"], "id", "points", "groups") == [("TRACK_7", 2, "SG_1 SG_2"), ("TRACK_8", 2, "SG_2 SG_3")]
    # the station where two routes meet stands once
    assert rows(got["service_patterns"], "id", "shape_id", "groups") == [("PATTERN_SR1", "GEOM_SERVICE_SR1", "SG_1 SG_2 SG_3"), ("PATTERN_SR2", "GEOM_SERVICE_SR2", "SG_2 SG_3")]
    assert rows(got["service_geometry"], "id", "min_zoom", "max_zoom", "points") == [("GEOM_CORRIDOR_SR1", 0, 7, 3), ("GEOM_CORRIDOR_SR2", 0, 7, 2), ("GEOM_SERVICE_SR1", 7, 24, 3), ("GEOM_SERVICE_SR2", 7, 24, 2)]


def test_trips_and_their_times(small):
    got = bundle.bundle(small, "trips", "stop_times")
    # the second train's line has no service; the last keeps its number whole
    assert rows(got["trips"], "id", "pattern_id") == [("TRIP_00001", "PATTERN_SR1"), ("TRIP_00003", "PATTERN_SR1"), ("TRIP_123456", "PATTERN_SR2")]
    far = 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(0.1) / 2) ** 2 + math.cos(math.radians(35)) * math.cos(math.radians(35.1)) * math.sin(math.radians(0.2) / 2) ** 2))
    assert rows(got["stop_times"], "trip_id", "sequence", "physical_id", "arrival_sec", "departure_sec", "distance") == [
        ("TRIP_00001", 1, "PS_1", 3600, 3600, 0.0), ("TRIP_00001", 3, "PS_3", 4200, 4200, pytest.approx(far, abs=0.01)),
        ("TRIP_00003", 1, "PS_1", 540, 600, 0.0), ("TRIP_00003", 4, "PS_3", 1200, 1260, pytest.approx(far, abs=0.01)),
    ]
    known, of = bundle.stop_patterns(got["stop_times"])
    assert rows(known, "pattern_no", "stops", "trips", "groups") == [(1, 2, 2, "SG_1 SG_3")] and rows(of, "trip_id", "pattern_no") == [("TRIP_00001", 1), ("TRIP_00003", 1)]


def test_references_and_layers(small):
    got = bundle.bundle(small)
    lost = {r["reference"]: r["rows"] for r in bundle.dangling(got).collect()}
    assert {k: v for k, v in lost.items() if v} == {"station_groups.id": 1, "trips.id": 1}
    layers = rows(bundle.gis_layers(got), "layer", "id", "name_en", "name_ja", "rank")
    assert layers[:4] == [("service_paths", "GEOM_CORRIDOR_SR1", "Ex", None, 0), ("service_paths", "GEOM_CORRIDOR_SR2", "Lo", None, 0), ("service_paths", "GEOM_SERVICE_SR1", "Ex", None, 0), ("service_paths", "GEOM_SERVICE_SR2", "Lo", None, 0)]
    assert layers[4:7] == [("stations", "PS_1", "a", "あ", 100), ("stations", "PS_2", "B", "B", 50), ("stations", "PS_3", "c", None, 50)]
