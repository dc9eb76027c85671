"""Operators that run in rounds, against plain passes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomrail.operators import labels, maps, scenario, timejoins


def plain_labels(rows, circles):
    taken, out = [], {}
    for i, _, name, x, y, font, preferred in sorted(rows, key=lambda r: r[1]):
        wide = len(name) * font * labels.CHARACTER
        tries = ([(0, *preferred)] if preferred else []) + [(k, dx - (wide if k in (3, 4) else 0), dy) for k, (dx, dy) in enumerate(labels.OFFSETS, 1)]
        best = None
        for k, dx, dy in tries:
            box = (x + dx, y + dy - font - 6, x + dx + max(28, wide), y + dy)
            hits = sum(not (box[2] + 6 < t[0] or t[2] + 6 < box[0] or box[3] + 6 < t[1] or t[3] + 6 < box[1]) for t in taken)
            for cx, cy, r in circles:
                near = (min(max(cx, box[0]), box[2]), min(max(cy, box[1]), box[3]))
                hits += 3 * ((cx, cy) != (x, y) and (cx - near[0]) ** 2 + (cy - near[1]) ** 2 <= (r + 6) ** 2)
            score = 1000 * hits + 0.05 * math.hypot(dx, dy)
            if best is None or score < best[0]:
                best = (score, k, dx, dy, hits, box)
                if not hits:
                    break
        taken.append(best[5])
        out[i] = best[1:5]
    return out


@pytest.mark.parametrize("size,side", [(500, 4000), (60, 250)])
def test_labels_as_one_pass(spark, size, side):
    rng = random.Random(size)
    rows = [(i, rng.random(), "n" * rng.randint(1, 14), round(rng.uniform(-side / 2, side / 2), 1), round(rng.uniform(0, side), 1), rng.choice([12.0, 13.0]), rng.choice([None, (20.0, -12.0)])) for i in range(size)]
    circles = [(r[3], r[4], 10.0) for r in rows]
    frame = spark.createDataFrame(rows, "label_id long, pos double, name string, x double, y double, font double, preferred struct<dx:double,dy:double>")
    got = labels.layout(frame, spark.createDataFrame(circles, "x double, y double, r double"))
    want = plain_labels(rows, circles)
    assert {r["label_id"]: (r["place"], r["dx"], r["dy"], r["overlaps"]) for r in got.placed.collect()} == {i: (k, pytest.approx(dx), dy, h) for i, (k, dx, dy, h) in want.items()}
    assert 1 < got.rounds < size


def jobs_of(spark, name, run):
    """Jobs that a run takes, and its result."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("block,size,side", [(40, 500, 4000), (30, 60, 250)])
def test_labels_in_blocks(spark, monkeypatch, block, size, side):
    monkeypatch.setattr(labels, "LABELS", block)
    test_labels_as_one_pass(spark, size, side)


def test_blocks_do_not_depend_on_partitions(spark):
    from loomrail.sources.storage import in_blocks

    rows = in_blocks(spark.range(0, 1000, 1, 50).repartition(60), 100, "id")
    bounds = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("block").collect()
    assert sum(r["n"] for r in bounds) == 1000 and 5 <= len(bounds) <= 10
    assert all(r["b"] < s["a"] for r, s in zip(bounds, bounds[1:]))


def test_labels_in_a_long_chain_take_few_jobs(spark):
    # each label waits for the one to its left
    rows = [(i, float(i), "abc", 40.0 * i, 0.0, 12.0, None) for i in range(30)]
    frame = spark.createDataFrame(rows, "label_id long, pos double, name string, x double, y double, font double, preferred struct<dx:double,dy:double>")
    none = spark.createDataFrame([], "x double, y double, r double")
    (got, rounds), jobs = jobs_of(spark, "labels", lambda: (lambda g: (g.placed.collect(), g.rounds))(labels.layout(frame, none)))
    want = plain_labels(rows, [])
    assert {r["label_id"]: (r["place"], r["dx"], r["dy"], r["overlaps"]) for r in got} == {i: (k, pytest.approx(dx), dy, h) for i, (k, dx, dy, h) in want.items()}
    assert rounds == 30 and jobs < 60


def test_labels_without_a_name_or_a_point(spark):
    rows = [(1, 0.0, None, 0.0, 0.0, 12.0, None), (2, 1.0, "abc", 1.0, 0.0, 12.0, None), (3, 2.0, "abc", None, 0.0, 12.0, None), (4, 3.0, "abc", 2.0, 0.0, 12.0, (1.0, None))]
    frame = spark.createDataFrame(rows, "label_id long, pos double, name string, x double, y double, font double, preferred struct<dx:double,dy:double>")
    got = {r["label_id"]: (r["place"], r["overlaps"]) for r in labels.layout(frame, spark.createDataFrame([], "x double, y double, r double")).placed.collect()}
    assert got == {1: (1, 0), 2: (3, 0), 3: (1, 0), 4: (0, 0)}


def test_labels_of_nothing_and_taken_boxes(spark):
    schema = "label_id long, pos double, name string, x double, y double, font double, preferred struct<dx:double,dy:double>"
    none = spark.createDataFrame([], "x double, y double, r double")
    assert labels.layout(spark.createDataFrame([], schema), none).placed.count() == 0
    one = spark.createDataFrame([(1, 0.0, "abc", 0.0, 0.0, 12.0, None)], schema)
    wall = spark.createDataFrame([(15.0, -300.0, 60.0, -2.0)], "x1 double, y1 double, x2 double, y2 double")
    # the first place meets the wall; the second begins at height -2, which is still within the space to keep
    got = labels.layout(one, none, wall).placed.first()
    assert (got["place"], got["overlaps"]) == (3, 0)


def plain_estimates(known, routes):
    plain, changed = dict(known), True
    while changed:
        changed = False
        for r in sorted(routes):
            for i, s in enumerate(routes[r]):
                before = [j for j in range(i) if plain[routes[r][j]]]
                after = [j for j in range(i + 1, len(routes[r])) if plain[routes[r][j]]]
                if plain[s] is None and before and after:
                    a, b = before[-1], after[0]
                    (la, lo), (ma, mo) = plain[routes[r][a]], plain[routes[r][b]]
                    plain[s], changed = (la + (ma - la) * (i - a) / (b - a), lo + (mo - lo) * (i - a) / (b - a)), True
    return plain


@pytest.mark.parametrize("seed", range(2))
def test_estimates_as_passes_over_routes(spark, seed):
    rng = random.Random(seed)
    ids = list(range(120))
    known = {i: (rng.random(), rng.random()) if rng.random() < 0.3 else None for i in ids}
    routes = {r: rng.sample(ids, rng.randint(1, 9)) for r in range(25)}
    stations = spark.createDataFrame([(i, *(known[i] or (None, None))) for i in ids], "station_id int, lat double, lon double")
    lines = spark.createDataFrame([(r, k, s) for r, x in routes.items() for k, s in enumerate(x)], "route_id int, pos int, station_id int")
    want, rows = plain_estimates(known, routes), maps.estimated(stations, lines).collect()
    assert len(rows) == 120
    for r in rows:
        w = want[r["station_id"]]
        assert (r["lat"], r["lon"]) == (pytest.approx(w) if w else (None, None))
        assert r["estimated"] == (w is not None and known[r["station_id"]] is None)


@pytest.mark.parametrize("places", [1, 12, 40])
def test_estimates_in_blocks(spark, monkeypatch, places):
    monkeypatch.setattr(maps, "PLACES", places)
    test_estimates_as_passes_over_routes(spark, 3)


@pytest.mark.parametrize("back", [False, True])
def test_estimates_of_a_long_chain_take_few_jobs(spark, back):
    # each route fills its middle station from the one that the route before, or after, it has filled
    size = 25
    known = {i: (float(i), 0.0) if i == 0 or i > size else None for i in range(2 * size + 1)}
    routes = {(size - k if back else k): [k, k + 1, k + 1 + size] for k in range(size)}
    stations = spark.createDataFrame([(i, *(v or (None, None))) for i, v in known.items()], "station_id long, lat double, lon double")
    lines = spark.createDataFrame([(r, k, s) for r, x in routes.items() for k, s in enumerate(x)], "route_id long, pos long, station_id long")
    rows, jobs = jobs_of(spark, f"chain {back}", lambda: maps.estimated(stations, lines).collect())
    want = plain_estimates(known, routes)
    assert {r["station_id"]: (r["lat"], r["lon"]) for r in rows} == {i: pytest.approx(w) for i, w in want.items()}
    assert jobs < 60


def test_estimates_query_as_passes(spark):
    rows = maps.QUERIES["estimated_route_coordinates"](spark, "/root/testdata/sf0.001").collect()
    assert 0 < sum(r["estimated"] for r in rows) < len(rows) and len({r["station_id"] for r in rows}) == len(rows)


def plain_plan(player, steps, visits):
    """One plan step after step."""
    station, minute, train, seq = player[2], player[3], None, None
    out = []
    for k, kind, until, trains, target, loop in steps:
        def row(end, place, t, s, choice, error):
            out.append((k, kind, minute, end, place, t, s, choice, error))
        if kind == "WAIT_UNTIL":
            error = "waits_on_a_train" if station is None else "waits_backwards" if until < minute else None
            row(until, station, train, None, None, error)
            minute = until
        elif kind in ("BOARD_TRAIN", "BOARD_ANY_OF"):
            best = None
            for c, t in enumerate(trains, 1):
                stops = [(v[4], v[1]) for v in visits if v[0] == t and station is not None and v[2] == station and v[4] >= minute]
                if stops:
                    best = (c, *min(stops), t)
                    break
            error = "boards_on_a_train" if station is None else "not_catchable_from_current_state" if not best else None
            row(best[1] if best else None, station, best[3] if best else train, best[2] if best else None, best[0] if best else None, error)
            if not error:
                station, minute, train, seq = None, best[1], best[3], best[2]
        elif kind == "RIDE_TO_STATION":
            off = [v for v in sorted(visits, key=lambda v: v[1]) if v[0] == train and v[2] == target and v[1] > (seq or 0) and (loop is None or v[5] == loop)] if train else []
            error = "rides_without_a_train" if train is None else "station_not_reached" if not off else None
            row(off[0][3] if off else None, target, train, off[0][1] if off else None, None, error)
            if not error:
                station, minute, train, seq = target, off[0][3], None, None
        else:
            row(None, station, train, None, None, "unsupported_step")
            break
        if out[-1][8]:
            break
    return out


def test_plans_as_steps_one_by_one(spark):
    rng = random.Random(8)
    visits, passes = [], {}
    for t in range(12):
        minute = rng.randint(0, 20)
        for s in range(1, 15):
            at = rng.randint(0, 5)
            passes[t, at] = passes.get((t, at), 0) + 1
            visits.append((t, s, at, minute, minute + rng.randint(0, 2), passes[t, at]))
            minute += rng.randint(0, 6)
    players = [(m, r, rng.randint(0, 5), rng.randint(0, 10)) for m in range(60) for r in (0, 1)]
    steps = {}
    for p in players:
        kinds = [rng.choice(["WAIT_UNTIL", "BOARD_TRAIN", "BOARD_ANY_OF", "RIDE_TO_STATION", "RIDE_TO_STATION", "BOARD_ANY_OF", "JUMP" if rng.random() < 0.2 else "WAIT_UNTIL"]) for _ in range(rng.randint(0, 7))]
        steps[p[:2]] = [(k, kind, rng.randint(0, 60) if kind == "WAIT_UNTIL" else None, [rng.randint(0, 13) for _ in range(1 if kind == "BOARD_TRAIN" else 4)] if "BOARD" in kind else None, rng.randint(0, 5) if kind == "RIDE_TO_STATION" else None, rng.choice([None, None, 2, 3]) if kind == "RIDE_TO_STATION" else None) for k, kind in enumerate(kinds, 1)]
    v = spark.createDataFrame([x[:5] for x in visits], "trip_id long, seq long, station_id int, minute int, dep int")
    p = spark.createDataFrame(players, "match_id long, role int, station_id int, minute int")
    schema = "match_id long, role int, step_index int, type string, until int, trains array<long>, target int, loop_pass int"
    s = spark.createDataFrame([(*k, *x) for k, xs in steps.items() for x in xs], schema)
    got = {}
    for r in scenario.resolved(p, s, v).collect():
        got.setdefault((r["match_id"], r["role"]), []).append(tuple(r)[2:])
    assert got == {pl[:2]: plain_plan(pl, steps[pl[:2]], visits) for pl in players if steps[pl[:2]]}
    assert scenario.resolved(p, spark.createDataFrame([], schema), v).count() == 0


def test_as_of_over_stretches(spark):
    rng = random.Random(1)
    facts = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 7)]), i) for i in range(300)] + [("hot", i % 500, i) for i in range(3000)]
    probes = [(i, rng.choice(["a", "b", "c", "hot", None]), rng.choice([None, *range(-5, 600)])) for i in range(400)]
    got = timejoins.as_of(spark.createDataFrame(probes, "id int, k string, t int"), spark.createDataFrame(facts, "k string, at int, n int"), "k", "t", "at", "n", stretch=50)
    rows = {r["id"]: r["fact"] and (r["fact"]["at"], r["fact"]["n"]) for r in got.collect()}
    for i, k, t in probes:
        known = [(at, n) for key, at, n in facts if key == k and k is not None and at is not None and t is not None and at <= t]
        assert rows[i] == (max(known) if known else None)
    assert len(rows) == 400


def test_pairs_over_stretches(spark):
    rng = random.Random(2)
    spans = []
    for i in range(300):
        begin = rng.randint(0, 900)
        spans.append((i, rng.choice(["x", "x", "y", None]), begin, begin + rng.choice([-1, 0, 0, 3, 40, 300])))
    frame = spark.createDataFrame(spans, "n int, place string, b int, e int")
    pairs = timejoins.overlapping_pairs(frame, "place", "b", "e", "n", stretch=25).select(F.col("a.n").alias("a"), F.col("b.n").alias("b")).collect()
    want = {(p[0], q[0]) for p in spans for q in spans if p[0] < q[0] and p[1] is not None and p[1] == q[1] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]}
    assert sorted(tuple(p) for p in pairs) == sorted(want) and len(want) > 100


def test_first_meeting_as_looks_at_every_minute(spark):
    rng = random.Random(11)
    spans = []
    for m in range(200):
        for _ in range(rng.randint(0, 12)):
            begin = rng.randint(0, 60)
            spans.append((m, rng.randint(0, 1), rng.choice(["NODE", "TRAIN"]), rng.randint(0, 3), begin, begin + rng.choice([-1, 0, 1, 4, 25])))
    want = {}
    for minute in range(90):
        for m in range(200):
            at = [{(k, p) for mm, r, k, p, b, e in spans if (mm, r) == (m, role) and b <= minute < e} for role in (0, 1)]
            if m not in want and at[0] & at[1]:
                want[m] = (minute, *min(at[0] & at[1], key=lambda x: (x[0] != "TRAIN", x[1])))
    # a span of more minutes than any list of them could hold
    spans += [(900, 0, "NODE", 7, 0, 10**13), (900, 1, "NODE", 7, 10**12, 10**13)]
    want[900] = (10**12, "NODE", 7)
    got = scenario.sampled(spark.createDataFrame(spans, "match_id long, role int, kind string, place long, begin long, end long")).collect()
    assert {r["match_id"]: tuple(r)[1:] for r in got} == want and len(want) > 20
