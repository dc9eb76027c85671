"""Every timetable query against the same query in DuckDB, and goldens made by hand."""

import json
import random
from urllib.parse import urljoin

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomrail.operators import datasets, maps, scenario, timetable_pages
from loomrail.plans import catalog
from loomrail.sources import documents
from loomrail.sources.adapters import stop_times
from loomrail.sources.storage import ranked

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    names = sorted(frame.columns)
    value = lambda v: None if pd.isna(v) else int(v) if isinstance(v, (int, float)) and v == int(v) else v
    return sorted(str([value(x) for x in row]) for row in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rooms_keep_every_command_of_closed_hours(spark):
    rows = catalog.queries()["room_clock_stream"](spark, SF)
    assert rows.count() == rows.select("room_id", "hour").distinct().count() > 0


def test_stop_times_key(spark):
    rows = stop_times(spark.read.parquet(f"{SF}/events.parquet"))
    assert rows.count() == rows.select("trip_id", "seq").distinct().count()


def test_loop_passes_count_visits(spark):
    st = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 5), (1, 4, 5)], "trip_id long, seq long, station_id int")
    rows = spark.sql(catalog.TEXTS["loop_pass_index"], st=st).orderBy("seq").collect()
    assert [r["loop_pass_index"] for r in rows] == [1, 1, 2, 3]


def test_names_by_hand(spark):
    from loomrail.functions import absolute_link, clock, minutes_of, normal_name, plain_text, service_parts, trip_id

    def one(**columns):
        return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()

    lit = F.lit
    assert one(a=normal_name(lit(" Shin-Ōsaka_(東)（x）・'’.,/ ")))["a"] == "shinōsaka東x"
    service, number = service_parts(lit("のぞみ12号"))
    plain, none = service_parts(lit("Hello "))
    assert tuple(one(a=service, b=number, c=plain, d=none)) == ("Nozomi", "12", "Hello", None)
    assert tuple(one(a=minutes_of(lit("25:05")), b=clock(lit(1505)), c=minutes_of(lit("x")), d=trip_id(lit(7)), e=trip_id(lit(1234567)))) == (1505, "25:05", None, "TRIP_00007", "TRIP_1234567")
    assert one(a=plain_text(lit("<td> a&nbsp;&amp;<b>b</b>\n c&eacute; </td>")))["a"] == "a & b cé"
    base = lit("https://h.org/a/b.html?q#f")
    got = one(**{f"c{i}": absolute_link(base, lit(h)) for i, h in enumerate(["/x", "y", "../z", "https://o.org/p", "//o.org/p", "?k", "#t"])})
    assert tuple(got) == tuple(urljoin("https://h.org/a/b.html?q#f", h) for h in ["/x", "y", "../z", "https://o.org/p", "//o.org/p", "?k", "#t"])


def test_anchors_by_hand(spark):
    page = """<a class=x href="/train/1"><b>One</b> &amp; two</a><a name=n>no</a><A HREF='list/2' >L</A><a href=q/3>3</a>"""
    rows = timetable_pages.anchors(spark.createDataFrame([(1, "https://h.org/t/", page), (2, None, None)], "page_id long, url string, html string"))
    assert [tuple(r)[2:] for r in rows.orderBy("pos").collect()] == [("/train/1", "One & two", "https://h.org/train/1"), ("list/2", "L", "https://h.org/t/list/2"), ("q/3", "3", "https://h.org/t/q/3")]
    assert [r["href"] for r in timetable_pages.timetable_links(rows).collect()] == ["list/2"] and timetable_pages.timetable_links(rows, "none").count() == 0


def test_merge_by_hand(spark):
    trains = spark.createDataFrame([("a", "1", "のぞみ", "5", 3), ("b", "2", "Nozomi", "5", 4), ("c", "3", "Nozomi", "5", 4), ("a", "9", None, "5", 1), ("b", "9", "X", "", 2)], "dataset string, train string, service string, number string, n long")
    assert sorted((r["merge_key"], r["train"], r["sources"]) for r in datasets.merged(trains).collect()) == [("service::Nozomi::5", "2", 3), ("train::9", "9", 2)]
    assert sorted((r["train"], r["resolution"].split("_")[0], r["kept_stop_count"], r["dropped_stop_count"]) for r in datasets.merge_steps(trains).collect()) == [("2", "replaced", 4, 3), ("3", "kept", 4, 4), ("9", "replaced", 2, 1)]


VISITS = [(1, 1, 10, 600, 601), (1, 2, 11, 620, 622), (1, 3, 12, 640, 641), (1, 4, 10, 660, 660), (2, 1, 11, 610, 612), (2, 2, 12, 630, 630)]


def played(spark, plans):
    visits = spark.createDataFrame(VISITS, "trip_id long, seq long, station_id int, minute int, dep int")
    players = spark.createDataFrame([(0, 0, 10, 590, 700), (0, 1, 12, 590, 700)], "match_id long, role int, station_id int, minute int, finish int")
    steps = spark.createDataFrame([(0, r, k, *s) for r, plan in enumerate(plans) for k, s in enumerate(plan, 1)], "match_id long, role int, step_index int, type string, until int, trains array<long>, target int")
    return players, steps, scenario.resolved(players, steps, visits)


def test_plan_by_hand(spark):
    runner = [("WAIT_UNTIL", 590, None, None), ("BOARD_TRAIN", None, [1], None), ("RIDE_TO_STATION", None, None, 11), ("BOARD_ANY_OF", None, [9, 2, 1], None), ("RIDE_TO_STATION", None, None, 12)]
    hunter = [("RIDE_TO_STATION", None, None, 11), ("WAIT_UNTIL", 650, None, None)]
    players, steps, done = played(spark, [runner, hunter])
    rows = {(r["role"], r["step_index"]): (r["begin"], r["end"], r["station_id"], r["train"], r["choice"], r["error"]) for r in done.collect()}
    assert rows == {(0, 1): (590, 590, 10, None, None, None), (0, 2): (590, 601, 10, 1, 1, None), (0, 3): (601, 620, 11, 1, None, None), (0, 4): (620, 622, 11, 1, 3, None), (0, 5): (622, 640, 12, 1, None, None), (1, 1): (590, None, 11, None, None, "rides_without_a_train")}
    spans = sorted(tuple(r)[1:] for r in scenario.intervals(players, steps, done).collect())
    assert spans == [(0, "NODE", 10, 590, 590), (0, "NODE", 10, 590, 601), (0, "NODE", 11, 620, 622), (0, "NODE", 12, 640, 700), (0, "TRAIN", 1, 601, 620), (0, "TRAIN", 1, 622, 640)]
    log = [(r["minute"], r["type"], r["player"]) for r in scenario.match_log(players, done).orderBy("pos").collect()]
    assert log == [(590, "SCENARIO_START", "-"), (590, "START_AT_STATION", "hunter"), (590, "START_AT_STATION", "runner"), (590, "WAIT_UNTIL", "runner"), (601, "BOARD_TRAIN", "runner"), (620, "PLAN_RESOLUTION", "runner"), (620, "ALIGHT_TRAIN", "runner"), (622, "BOARD_TRAIN", "runner"), (640, "ALIGHT_TRAIN", "runner"), (640, "CAPTURE", "-")]


def test_capture_on_a_train_and_no_capture_while_waiting(spark):
    runner = [("BOARD_TRAIN", None, [1], None), ("RIDE_TO_STATION", None, None, 12)]
    players, _, done = played(spark, [runner, [("WAIT_UNTIL", 595, None, None)]])
    hunter = players.where("role = 0").withColumns({"role": F.lit(1)})
    both = players.where("role = 0").unionByName(hunter.withColumn("station_id", F.lit(11)))
    same = done.where("role = 0").unionByName(done.where("role = 0 and step_index = 1").withColumns({"role": F.lit(1), "end": F.lit(601)}))
    last = scenario.match_log(both, same).orderBy(F.desc("pos")).first()
    assert (last["type"], last["minute"], last["runner"], last["hunter"]) == ("CAPTURE", 601, "T1", "T1")


def test_estimated_coordinates_as_a_sequential_pass(spark):
    rng = random.Random(5)
    ids = list(range(30))
    known = {i: (rng.random(), rng.random()) if rng.random() < 0.4 else None for i in ids}
    routes = {r: rng.sample(ids, 9) for r in range(4)}
    plain, changed = dict(known), True
    while changed:
        changed = False
        for r in sorted(routes):
            for i, s in enumerate(routes[r]):
                before = [j for j in range(i) if plain[routes[r][j]]]
                after = [j for j in range(i + 1, 9) if plain[routes[r][j]]]
                if plain[s] is None and before and after:
                    a, b = before[-1], after[0]
                    (la, lo), (ma, mo) = plain[routes[r][a]], plain[routes[r][b]]
                    plain[s], changed = (la + (ma - la) * (i - a) / (b - a), lo + (mo - lo) * (i - a) / (b - a)), True
    stations = spark.createDataFrame([(i, *(known[i] or (None, None))) for i in ids], "station_id int, lat double, lon double")
    lines = spark.createDataFrame([(r, k, s) for r, x in routes.items() for k, s in enumerate(x)], "route_id int, pos int, station_id int")
    for r in maps.estimated(stations, lines).collect():
        want = plain[r["station_id"]]
        assert (r["lat"], r["lon"]) == (pytest.approx(want) if want else (None, None))
        assert r["estimated"] == (want is not None and known[r["station_id"]] is None)


def test_features_are_geojson_and_sources_may_be_absent(spark, tmp_path):
    texts = [json.loads(r["feature"]) for r in maps.features(maps._layers(spark, SF)).collect()]
    assert {t["geometry"]["type"] for t in texts} == {"Point", "LineString"}
    assert all(len(t["bbox"]) == 4 and len(t["geometry"]["coordinates"]) >= 2 for t in texts if t["geometry"]["type"] == "LineString")
    whole = {r["layer"]: json.loads(r["document"]) for r in documents.collection(maps.features(maps._layers(spark, SF))).collect()}
    assert sum(len(d["features"]) for d in whole.values()) == len(texts)
    assert documents.optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "some.json").write_text('{"a": 1}\n')
    assert documents.optional(spark, str(tmp_path / "some.json"), "a int").count() == 1


def test_ranks_go_on_over_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v")).repartition(7)
    assert all(r["rank"] == r["v"] + 1 for r in ranked(rows, "v").collect())
