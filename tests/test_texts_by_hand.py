"""Results worked out by hand for the queries that both engines run from one text."""

import math

import pytest

from loomrail.plans import catalog

# trip 1 goes 24, 0, 1, 1, 24; trip 2 goes 3, 2; trip 3 stays at 5
VISITS = [
    (1, 1, 24, 590, 591, 1, "view"), (1, 2, 0, 600, 602, 2, "click"), (1, 3, 1, 620, 620, 4, "view"), (1, 4, 1, 630, 632, 5, "click"), (1, 5, 24, 660, 661, 6, "buy"),
    (2, 1, 3, 605, 606, 7, "view"), (2, 2, 2, 5000, 5002, 8, "click"),
    (3, 1, 5, 1430, 1431, 9, "view"),
]


@pytest.fixture(scope="module")
def asked(spark):
    st = spark.createDataFrame(VISITS, "trip_id long, seq long, station_id int, minute int, dep int, event_id long, event_type string")
    nation = spark.createDataFrame([(k, f"N{k}", k % 5) for k in range(25)], "n_nationkey long, n_name string, n_regionkey long")
    region = spark.createDataFrame([(k, f"R{k}") for k in range(5)], "r_regionkey long, r_name string")
    supplier = spark.createDataFrame([(1, 3), (2, 3), (3, 8), (4, 22), (6, 99)], "s_suppkey long, s_nationkey long")
    part = spark.createDataFrame([(1, "Brand#12", "PROMO BRASS"), (2, "Other7", "promo"), (3, "None", " 9 x")], "p_partkey long, p_brand string, p_type string")
    source = spark.createDataFrame([("A", 1, 4), ("N", 1, 6), ("R", 1, 6), ("N", 2, 3), ("R", 3, 5), ("A", 3, 5)], "source string, train long, n long")
    point = spark.createDataFrame([(1, 128.1, 46.4), (2, 140.0, 38.25), (3, 146.5, 30.0), (21, 128.1, 46.3), (4, 131.0, 35.0), (7, 132.0, 36.0)], "point_id long, lon double, lat double")

    def ask(name, *columns):
        text = catalog.CHOICE.sub(r"\1", catalog.TEXTS[name])
        tables = {k: v for k, v in {"st": st, "nation": nation, "region": region, "supplier": supplier, "part": part, "src": source, "pt": point}.items() if "{" + k + "}" in text}
        rows = spark.sql(text, **tables)
        return sorted(tuple(r) for r in (rows.select(*columns) if columns else rows).collect())

    return ask


def test_boarding(asked):
    # the first departure of each trip at a station from minute 600 on
    assert asked("next_departures_topk", "station_id", "trip_id", "dep", "rank") == [(0, 1, 602, 1), (1, 1, 620, 1), (2, 2, 5002, 1), (3, 2, 606, 1), (5, 3, 1431, 1), (24, 1, 661, 1)]
    assert asked("segments", "trip_id", "seq", "from_station", "to_station", "dep", "arr") == [(1, 1, 24, 0, 591, 600), (1, 2, 0, 1, 602, 620), (1, 3, 1, 1, 620, 630), (1, 4, 1, 24, 632, 660), (2, 1, 3, 2, 606, 5000)]
    assert asked("consecutive_dedupe", "trip_id", "seq") == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (2, 2), (3, 1)]
    assert asked("loop_pass_index", "trip_id", "seq", "loop_pass_index") == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2), (2, 1, 1), (2, 2, 1), (3, 1, 1)]
    # the boarded station's next visit ends the stops ahead
    assert asked("future_stops_until_return", "trip_id", "seq", "station_id") == [(1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 24), (2, 2, 2)]
    assert asked("reachable_semi", "station_id") == [(2,)]


def test_ways_along_a_loop(asked):
    assert asked("direction_inference", "trip_id", "direction") == [(1, "forward"), (2, "backward"), (3, "unknown")]
    # 24 to 0 goes on over the edge, 1 to 24 comes back
    assert asked("unwrap_offsets", "trip_id", "seq", "y") == [(1, 1, 24), (1, 2, 25), (1, 3, 26), (1, 4, 26), (1, 5, 24), (2, 1, 3), (2, 2, 2), (3, 1, 5)]
    assert asked("hour_ticks", "tick") == [(60 * h,) for h in range(9, 85)]
    assert asked("panel_train_counts", "panel", "trains") == [(1, 1), (4, 1)]


def test_times(asked):
    assert asked("hhmm_roundtrip", "trip_id", "seq", "hhmm", "back")[:2] == [(1, 1, "09:50", 590), (1, 2, "10:00", 600)] and (2, 2, "83:20", 5000) in asked("hhmm_roundtrip", "trip_id", "seq", "hhmm", "back")
    # events 1, 5 and 9 have no arrival, 2 and 6 no departure
    assert asked("coalesced_times", "trip_id", "seq", "departure", "arrival") == [(1, 1, 591, 591), (1, 2, 600, 600), (1, 3, 620, 620), (1, 4, 632, 632), (1, 5, 660, 660), (2, 1, 606, 605), (2, 2, 5002, 5000), (3, 1, 1431, 1431)]
    # every third place is known, those between lie on a line
    assert asked("gap_interpolate", "trip_id", "seq", "y") == [(1, 1, 24.0), (1, 2, pytest.approx(24 - 23 / 3, abs=1e-6)), (1, 3, pytest.approx(24 - 46 / 3, abs=1e-6)), (1, 4, 1.0), (1, 5, 1.0), (2, 1, 3.0), (2, 2, 3.0), (3, 1, 5.0)]


def test_states_at_minutes(asked):
    assert asked("nearest_stop_in_time", "trip_id", "at_minute", "seq") == [(1, 600, 2), (1, 5000, 5), (1, 20000, 5), (2, 600, 1), (2, 5000, 2), (2, 20000, 2), (3, 600, 1), (3, 5000, 1), (3, 20000, 1)]
    assert asked("train_position_at", "trip_id", "at_minute", "from_station", "to_station", "progress") == [(1, 600, 0, 1, 0.0), (1, 5000, 24, None, 1.0), (1, 20000, 24, None, 1.0), (2, 5000, 2, None, 1.0), (2, 20000, 2, None, 1.0), (3, 5000, 5, None, 1.0), (3, 20000, 5, None, 1.0)]
    assert asked("player_state_at_minute", "trip_id", "at_minute", "event_type") == [(1, 600, "click"), (1, 5000, "buy"), (1, 20000, "buy"), (2, 5000, "click"), (2, 20000, "click"), (3, 5000, "view"), (3, 20000, "view")]
    assert asked("hourly_planning_windows", "trip_id", "window_no", "events", "first_minute", "last_minute") == [(1, 3, 1, 590, 590), (1, 4, 3, 600, 630), (1, 5, 1, 660, 660), (2, 4, 1, 605, 605), (2, 77, 1, 5000, 5000), (3, 17, 1, 1430, 1430)]
    shown = dict(zip([(v[0], v[1]) for v in VISITS], ["full"] * 5 + ["station", "segment", "full"]))
    assert asked("visibility_projection", "trip_id", "seq", "shown") == sorted((t, s, "hidden" if m % 1440 < 360 else shown[t, s]) for t, s, _, m, *_ in VISITS)
    assert asked("hop_replay_states", "trip_id", "seq", "state_before", "state_after", "mark")[:3] == [(1, 1, -1, 24, "DONE"), (1, 2, 24, 0, "DONE"), (1, 3, 0, 1, "NEXT")]


def test_merging(asked):
    assert asked("dedupe_longest", "train", "source", "n") == [(1, "N", 6), (2, "N", 3), (3, "A", 5)]
    assert asked("merge_sources_longest", "train", "dataset_pos", "kept_stops", "sources") == [(1, 2, 6, 3), (2, 2, 3, 1), (3, 1, 5, 2)]
    # each later source against the best before it
    kept, replaced = "kept_existing_longer_or_equal_stop_list", "replaced_with_longer_stop_list"
    assert asked("merge_report", "train", "source", "resolution", "kept_stop_count", "dropped_stop_count") == [(1, "N", replaced, 6, 4), (1, "R", kept, 6, 6), (3, "R", kept, 5, 5)]
    assert asked("service_name_split", "id", "service", "number") == [(1, "Brand", "12"), (2, "Other", "7"), (3, "", "")]
    # trip 1 is on line 1: station 24 has a name of its own on line 4 only; 0 and 21 have no name alone
    assert asked("resolve_with_override", "trip_id", "seq", "resolved") == [(1, 1, 24), (1, 2, None), (1, 3, 1), (1, 4, 1), (1, 5, 24), (2, 1, 3), (2, 2, 2), (3, 1, 5)]
    assert asked("unresolved_keys") == [(3,), (99,)]
    # 3 is no multiple of six; supplier 2 has a point of its own, 3 the next one's, 6 the one after it
    assert asked("coordinate_enrichment", "id", "status", "lat") == [(1, "missing", None), (2, "primary", 38.25), (3, "secondary", 35.0), (4, "primary", 35.0), (6, "secondary", 36.0)]


def test_network(asked):
    assert asked("adjacency_pairs", "a", "b", "trips", "routes") == [(0, 1, 1, 1), (0, 24, 1, 1), (1, 24, 1, 1), (2, 3, 1, 1)]
    assert asked("interchange_stations") == []
    assert asked("service_families") == [("PROMO",), ("other",), ("promo",)]
    # trips begin at 24 (region 4), 3 (region 3) and 5 (region 0)
    assert asked("route_summary_left", "route_id", "name", "trains") == [(0, "R0", 1), (1, "R1", 0), (2, "R2", 0), (3, "R3", 1), (4, "R4", 1)]
    # there and back, the turning point once
    assert [s for r, p, s in asked("route_concat", "route", "pos", "station") if r == 2] == [2, 7, 12, 17, 22, 17, 12, 7, 2]
    extra = [r for r in asked("set_equality_check", "side", "id") if r[0] == "extra"]
    assert extra == [("extra", 22), ("extra", 99)] and ("missing", 3) not in asked("set_equality_check", "side", "id") and ("missing", 8) in asked("set_equality_check", "side", "id")
    assert asked("station_sequence_complete", "missing") == [(0,), (5,), (10,), (15,), (20,)]
    assert asked("summary_counts", "kind", "n", "trips", "first_minute", "last_minute") == [("buy", 1, 1, 660, 660), ("click", 3, 2, 600, 5000), ("view", 4, 3, 590, 1430)]


def test_places(asked):
    tiles = lambda p: sorted((x, y) for i, z, x, y in asked("tile_assign_z3", "point_id", "z", "x", "y") if i == p)
    # a box at the corner of the map, one across no edge, and one at the far corner
    assert tiles(1) == [(0, 0)] and tiles(3) == [(7, 7)] and tiles(2) == [(5, 3), (5, 4)]
    assert asked("polyline_bbox", "line", "points", "min_lon", "min_lat", "max_lon", "max_lat") == [(1, 2, 128.1, 46.3, 128.1, 46.4)]
    assert asked("project_points", "point_id", "px", "py")[:2] == [(1, 20.0, 20.0), (2, 640.87, 318.17)]
    far = {p: d for _, p, d in asked("shape_distance", "line", "point_id", "dist")}
    assert far[1] == 0.0 and far[21] == pytest.approx(6371000 * math.radians(0.1), abs=0.01)
