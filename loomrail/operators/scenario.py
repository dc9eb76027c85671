"""Two-sided pursuit: plans resolved step by step into intervals and events, the log of a match, and captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.operators.timejoins import as_of
from loomrail.sources.adapters import SQL, read, stop_times

# The order of events of one minute, their families, and which of them belong to the match or may capture.
PRIORITY = {"SCENARIO_START": 0, "START_AT_STATION": 1, "WAIT_UNTIL": 2, "PLAN_RESOLUTION": 3, "BOARD_TRAIN": 4, "ALIGHT_TRAIN": 5, "CAPTURE": 6, "SCENARIO_END": 7}
FAMILY = {"SCENARIO_START": "LIFECYCLE", "SCENARIO_END": "LIFECYCLE", "CAPTURE": "RESOLUTION", "START_AT_STATION": "POSITION", "WAIT_UNTIL": "POSITION", "BOARD_TRAIN": "MOVEMENT", "ALIGHT_TRAIN": "MOVEMENT", "PLAN_RESOLUTION": "PLANNING"}
GLOBAL = ("SCENARIO_START", "CAPTURE", "SCENARIO_END")
CHECKED = ("SCENARIO_START", "START_AT_STATION", "BOARD_TRAIN", "ALIGHT_TRAIN")
PLAYER = ["match_id", "role"]


def _by(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key], F.lit(default))


def _packed(players: DataFrame, steps: DataFrame, visits: DataFrame) -> DataFrame:
    """players with their steps in order, and the visits that a plan can touch: of its trains, at its start or its targets."""
    if "loop_pass" not in visits.columns:
        visits = visits.withColumn("loop_pass", F.row_number().over(Window.partitionBy("trip_id", "station_id").orderBy("seq")))
    if "loop_pass" not in steps.columns:
        steps = steps.withColumn("loop_pass", F.lit(None).cast("int"))
    plans = steps.groupBy(*PLAYER).agg(F.array_sort(F.collect_list(F.struct("step_index", "type", "until", "trains", "target", "loop_pass"))).alias("steps"))
    plans = players.select(*PLAYER, "station_id", "minute").join(plans, PLAYER)
    wish = plans.select(*PLAYER, F.array_union(F.array("station_id"), F.transform("steps", lambda s: s["target"])).alias("places"), F.explode(F.array_distinct(F.flatten(F.transform("steps", lambda s: F.coalesce(s["trains"], F.array().cast("array<long>")))))).alias("trip_id"))
    stops = visits.select("trip_id", F.struct(F.col("trip_id").alias("train"), F.col("seq"), F.col("station_id").alias("at"), F.col("minute").alias("arr"), "dep", "loop_pass").alias("stop"))
    touched = wish.join(stops, "trip_id").where(F.array_contains("places", F.col("stop.at")))
    held = touched.groupBy(*PLAYER).agg(F.collect_list("stop").alias("stops"))
    return plans.join(held, PLAYER, "left").withColumn("stops", F.coalesce("stops", F.expr("filter(array(struct(0L AS train, 0L AS seq, 0 AS at, 0 AS arr, 0 AS dep, 0 AS loop_pass)), x -> false)")))


#: What one step comes to, as SQL over acc (station, minute, train, seq, stopped, done), the step s, and b (best boarding, getting off).
_BOARDS, _RIDES, _WAITS = "s.type IN ('BOARD_TRAIN', 'BOARD_ANY_OF')", "s.type = 'RIDE_TO_STATION'", "s.type = 'WAIT_UNTIL'"
_BEST = """array_min(transform(filter(stops, v -> acc.station IS NOT NULL AND array_contains(s.trains, v.train) AND v.at = acc.station AND v.dep >= acc.minute),
  v -> struct(CAST(array_position(s.trains, v.train) AS INT) AS choice, v.dep AS dep, v.seq AS seq, v.train AS train)))"""
_OFF = "array_min(transform(filter(stops, v -> v.train = acc.train AND v.at = s.target AND v.seq > acc.seq AND (s.loop_pass IS NULL OR v.loop_pass = s.loop_pass)), v -> struct(v.seq AS seq, v.arr AS arr)))"
_ERROR = f"""CASE WHEN {_WAITS} AND acc.station IS NULL THEN 'waits_on_a_train' WHEN {_WAITS} AND s.until < acc.minute THEN 'waits_backwards'
  WHEN {_BOARDS} AND acc.station IS NULL THEN 'boards_on_a_train' WHEN {_BOARDS} AND b.best IS NULL THEN 'not_catchable_from_current_state'
  WHEN {_RIDES} AND acc.train IS NULL THEN 'rides_without_a_train' WHEN {_RIDES} AND b.off IS NULL THEN 'station_not_reached'
  WHEN NOT ({_WAITS} OR {_BOARDS} OR {_RIDES}) THEN 'unsupported_step' END"""
_ROW = f"""struct(s.step_index AS step_index, s.type AS type, acc.minute AS begin, CASE WHEN {_WAITS} THEN s.until ELSE coalesce(b.best.dep, b.off.arr) END AS end, CASE WHEN {_RIDES} THEN s.target ELSE acc.station END AS station_id,
  coalesce(b.best.train, acc.train) AS train, coalesce(b.best.seq, b.off.seq) AS seq, b.best.choice AS choice, {_ERROR} AS error)"""
_STATE = "struct<station:int,minute:int,train:bigint,seq:bigint,stopped:boolean,done:array<struct<step_index:int,type:string,begin:int,end:int,station_id:int,train:bigint,seq:bigint,choice:int,error:string>>>"
_NEXT = f"""CASE WHEN acc.stopped THEN acc ELSE transform(array(struct({_BEST} AS best, {_OFF} AS off)), b -> transform(array({_ROW}), r -> CAST(struct(
  CASE WHEN {_BOARDS} THEN NULL ELSE r.station_id END AS station, r.end AS minute, CASE WHEN {_BOARDS} THEN r.train END AS train, CASE WHEN {_BOARDS} THEN r.seq END AS seq,
  r.error IS NOT NULL AS stopped, concat(acc.done, array(r)) AS done) AS {_STATE}))[0])[0] END"""
_FOLD = f"aggregate(steps, CAST(struct(station_id, minute, NULL, NULL, false, array()) AS {_STATE}), (acc, s) -> {_NEXT}, acc -> acc.done)"


def resolved(players: DataFrame, steps: DataFrame, visits: DataFrame) -> DataFrame:
    """(match_id, role, step_index, type, begin, end, station_id, train, seq, choice, error): what each step of each plan came to.

    players: match_id, role, station_id, minute. steps: match_id, role, step_index, type, until, trains,
    target, and loop_pass where only that visit of the target counts; trains are tried in order. visits
    may have loop_pass, else visits of a station are counted. begin and end are minutes; station_id is
    where a waiting or boarding player stands and where a riding one gets off; choice is the place of
    the train taken among trains, from 1. A step that can't be done has an error and ends the plan.
    Plans are folded in one expression over the visits they can touch, whatever the number of steps;
    no steps give no rows.
    """
    return _packed(players, steps, visits).select(*PLAYER, F.inline(F.expr(_FOLD)))


def intervals(players: DataFrame, steps: DataFrame, done: DataFrame) -> DataFrame:
    """(match_id, role, kind, place, begin, end) of resolved steps: waits even of no length, waits before boarding, rides, and the hold at the end of plans without an error."""
    kind = F.when(F.col("type") == "RIDE_TO_STATION", "TRAIN").otherwise("NODE")
    place = F.when(F.col("type") == "RIDE_TO_STATION", F.col("train")).otherwise(F.col("station_id")).cast("long")
    good = done.where("error is null")
    spent = good.where((F.col("type").isin("WAIT_UNTIL", "RIDE_TO_STATION")) | (F.col("end") > F.col("begin"))).select(*PLAYER, kind.alias("kind"), place.alias("place"), "begin", "end")
    final = done.groupBy(*PLAYER).agg(F.max_by(F.struct("type", "station_id", "end", "error"), "step_index").alias("x"), F.count("*").alias("n"))
    hold = final.join(players.select(*PLAYER, F.col("finish")), PLAYER).where("x.error is null and x.type not in ('BOARD_TRAIN', 'BOARD_ANY_OF') and x.end < finish")
    return spent.unionByName(hold.select(*PLAYER, F.lit("NODE").alias("kind"), F.col("x.station_id").cast("long").alias("place"), F.col("x.end").alias("begin"), F.col("finish").alias("end")))


def match_log(players: DataFrame, done: DataFrame) -> DataFrame:
    """(match_id, pos, minute, type, player, runner, hunter, scope, lane, family): each match's events to the first capture, or to its end.

    runner and hunter are where the two are after the event, N and the station or T and the train.
    Captures are looked for after a start, boarding and alighting; on the same train comes before at
    the same station.
    """
    good = done.where("error is null")
    node, train = F.concat(F.lit("N"), F.col("station_id").cast("string")), F.concat(F.lit("T"), F.col("train").cast("string"))
    event = lambda rows, kind, minute, player, after, step: rows.select("match_id", F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), minute.cast("long").alias("minute"), player.alias("player"), after.alias("after"), step.cast("long").alias("step"))
    none = F.lit(None).cast("string")
    name = F.when(F.col("role") == 0, "runner").otherwise("hunter")
    starts = event(players, "START_AT_STATION", F.col("minute"), name, node, F.lit(0))
    opening = event(players.where("role = 0"), "SCENARIO_START", F.col("minute"), none, none, F.lit(-1))
    kinds = F.when(F.col("type") == "WAIT_UNTIL", F.col("type")).when(F.col("type") == "RIDE_TO_STATION", "ALIGHT_TRAIN").otherwise("BOARD_TRAIN")
    moves = event(good, kinds, F.col("end"), name, F.when(kinds == "BOARD_TRAIN", train).otherwise(node), F.col("step_index"))
    choices = event(good.where("type = 'BOARD_ANY_OF'"), "PLAN_RESOLUTION", F.col("begin"), name, none, F.col("step_index"))
    events = reduce(DataFrame.unionByName, [opening, starts, moves, choices])
    order = Window.partitionBy("match_id").orderBy("minute", _by(PRIORITY, F.col("type"), 99), F.coalesce("player", F.lit("")), "step")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    begin = players.groupBy("match_id").agg(*(F.max(F.when(F.col("role") == r, node)).alias(f"{n}_0") for r, n in ((0, "runner"), (1, "hunter"))), F.max("finish").alias("finish"))
    where = lambda who: F.coalesce(F.last(F.when(F.col("player") == who, F.col("after")), True).over(so_far), F.col(f"{who}_0"))
    seen = events.join(begin, "match_id").withColumns({"pos": F.row_number().over(order), "runner": where("runner"), "hunter": where("hunter")})
    hit = F.col("type").isin(*CHECKED) & (F.col("runner") == F.col("hunter"))
    cut = seen.withColumn("capture", F.min(F.when(hit, F.col("pos"))).over(Window.partitionBy("match_id"))).where("capture is null or pos <= capture")
    shown = cut.select("match_id", F.col("pos").cast("long"), "minute", "type", "player", "runner", "hunter")
    ends = cut.groupBy("match_id").agg(F.max(F.struct("pos", "minute", "runner", "hunter")).alias("x"), F.max("capture").alias("capture"), F.max("finish").alias("finish"))
    closing = ends.select("match_id", (F.col("x.pos") + 1).cast("long").alias("pos"), F.when(F.col("capture").isNull(), F.col("finish").cast("long")).otherwise(F.col("x.minute")).alias("minute"), F.when(F.col("capture").isNull(), "SCENARIO_END").otherwise("CAPTURE").alias("type"), none.alias("player"), F.col("x.runner").alias("runner"), F.col("x.hunter").alias("hunter"))
    return shown.unionByName(closing).withColumns({"scope": F.when(F.col("type").isin(*GLOBAL), "MATCH_GLOBAL").otherwise("PLAYER_LOCAL"), "lane": F.coalesce("player", F.lit("match")), "family": _by(FAMILY, F.col("type"), "GENERIC"), "player": F.coalesce("player", F.lit("-"))})


def overlaps(spans: DataFrame) -> DataFrame:
    """(match_id, minute, kind, place): the first minute that both players spend in one place, or on one train; ends of spans count."""
    side = lambda r, n: spans.where(F.col("role") == r).select("match_id", "kind", "place", F.col("begin").alias(f"b{n}"), F.col("end").alias(f"e{n}"))
    both = side(0, 1).join(side(1, 2), ["match_id", "kind", "place"])
    start, stop = F.greatest("b1", "b2"), F.least("e1", "e2")
    met = both.where(start <= stop)
    # on a train before at a station, as T sorts after N
    first = met.groupBy("match_id").agg(F.min(F.struct(start.alias("minute"), F.when(F.col("kind") == "TRAIN", 0).otherwise(1).alias("o"), "place")).alias("x"))
    return first.select("match_id", F.col("x.minute").alias("minute"), F.when(F.col("x.o") == 0, "TRAIN").otherwise("NODE").alias("kind"), F.col("x.place").alias("place"))


def sampled(spans: DataFrame) -> DataFrame:
    """(match_id, minute, kind, place): the first minute at which a look at both players finds them in one place or on one train.

    A player is where its span began until the minute before it ends, so a span of no length is never seen.
    The first such minute is the begin of a span, so no minute is looked at by itself.
    """
    # spans of a place in order of their begin: the one before that ends last tells whether another player is still there
    order = Window.partitionBy("match_id", "kind", "place").orderBy("begin", "end", "role").rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.where("begin < end AND role IS NOT NULL").withColumn("before", F.max(F.struct("end", "role")).over(order))
    both = seen.where((F.col("before.end") > F.col("begin")) & (F.col("before.role") != F.col("role")))
    first = both.groupBy("match_id").agg(F.min(F.struct("begin", F.when(F.col("kind") == "TRAIN", 0).otherwise(1).alias("o"), "place")).alias("f"))
    return first.select("match_id", F.col("f.begin").alias("minute"), F.when(F.col("f.o") == 0, "TRAIN").otherwise("NODE").alias("kind"), F.col("f.place").alias("place"))


def previewed(players: DataFrame, done: DataFrame, cap: Column) -> DataFrame:
    """(match_id, role, steps, minute, kind, place, error): where each player is after the steps that end by `cap`, a column of players; error is that of the plan if it comes by then."""
    at = players.select(*PLAYER, F.col("station_id").alias("home"), F.col("minute").alias("start"), cap.alias("cap"))
    known = at.join(done, PLAYER, "left")
    applied = F.col("error").isNull() & (F.col("end") <= F.col("cap"))
    last = known.groupBy(*PLAYER, "home", "start").agg(F.max(F.when(applied, F.struct("step_index", "type", "end", "station_id", "train"))).alias("x"), F.max(F.when(F.col("error").isNotNull() & (F.col("begin") <= F.col("cap")), F.col("error"))).alias("error"))
    aboard = F.col("x.type").isin("BOARD_TRAIN", "BOARD_ANY_OF")
    place = F.when(aboard, F.col("x.train")).otherwise(F.coalesce("x.station_id", "home").cast("long"))
    return last.select(*PLAYER, F.coalesce("x.step_index", F.lit(0)).alias("steps"), F.coalesce("x.end", "start").alias("minute"), F.when(aboard, "TRAIN").otherwise("NODE").alias("kind"), place.alias("place"), "error")


def projected(preview: DataFrame, live: Column) -> DataFrame:
    """(match_id, viewer, target, visibility, kind, place): what each seat of a match is shown of each seat.

    preview: rows of previewed; live: whether the match is running, a column of it. One's own seat is
    shown in full; the other is hidden while the match runs, else shown with its station, or without
    its train where it rides.
    """
    seats = preview.select("match_id", F.col("role").alias("viewer"))
    other = F.col("viewer") != F.col("target")
    rows = seats.join(preview.select("match_id", F.col("role").alias("target"), "kind", "place", live.alias("live")), "match_id")
    seen = F.when(~other, "full").when(F.col("live"), "hidden").when(F.col("kind") == "NODE", "station").otherwise("segment")
    rows = rows.withColumn("visibility", seen)
    return rows.select("match_id", "viewer", "target", "visibility", F.when(F.col("visibility") == "hidden", "HIDDEN").otherwise(F.col("kind")).alias("kind"), F.when(F.col("visibility").isin("full", "station"), F.col("place")).alias("place"))


def replayed(log: DataFrame, visits: DataFrame) -> DataFrame:
    """(match_id, pos, player, kind, place, from_station, to_station, progress): where each player is on the map after each event of a log.

    A player at a station is there; one on a train is at the stop or on the leg that the train has
    reached at the event's minute, found by one as-of join of all events with all visits.
    """
    order = Window.partitionBy("trip_id").orderBy("seq")
    legs = visits.select("trip_id", "seq", "station_id", "minute", "dep", F.lead("station_id").over(order).alias("to_station"), F.lead("minute").over(order).alias("arr"))
    both = log.select("match_id", "pos", "minute", F.inline(F.array(F.struct(F.lit("runner").alias("player"), F.col("runner").alias("at")), F.struct(F.lit("hunter").alias("player"), F.col("hunter").alias("at")))))
    asked = both.select("match_id", "pos", "player", "minute", F.when(F.startswith("at", F.lit("T")), "TRAIN").otherwise("NODE").alias("kind"), F.substring("at", 2, 20).cast("long").alias("place"))
    got = as_of(asked.withColumn("trip_id", F.when(F.col("kind") == "TRAIN", F.col("place"))), legs, "trip_id", "minute", "minute", "seq")
    rides = F.col("fact.to_station").isNotNull()
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("minute") - F.col("fact.dep")) / F.greatest(F.lit(1), F.col("fact.arr") - F.col("fact.dep"))))
    return got.select("match_id", "pos", "player", "kind", "place", F.coalesce("fact.station_id", F.when(F.col("kind") == "NODE", F.col("place")).cast("int")).alias("from_station"), "fact.to_station", F.when(rides, share).alias("progress"))


def cast(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players and steps out of visits: trip 2m runs from trip 2m + 1. Each waits for its first visit, takes its own train to its fourth station, then one of three trains to its ninth."""
    m, role = F.floor(F.col("trip_id") / 2).alias("match_id"), (F.col("trip_id") % 2).cast("int").alias("role")
    at = lambda k, c: F.max(F.when(F.col("seq") == k, F.col(c)))
    trips = visits.groupBy("trip_id").agg(at(1, "station_id").alias("home"), at(1, "minute").alias("first"), at(4, "station_id").alias("s4"), at(9, "station_id").alias("s9"), F.max("dep").alias("final"))
    match = Window.partitionBy(F.floor(F.col("trip_id") / 2))
    trips = trips.withColumns({"start": F.min("first").over(match), "finish": F.max("final").over(match) + 100})
    players = trips.select(m, role, F.col("home").alias("station_id"), F.col("start").alias("minute"), "finish")
    t = F.col("trip_id")
    none, no = F.lit(None), F.lit(None).cast("array<long>")
    plan = [("WAIT_UNTIL", F.col("first"), no, none), ("BOARD_TRAIN", none, F.array(F.when(t % 7 == 3, F.lit(-1).cast("long")).otherwise(t)), none), ("RIDE_TO_STATION", none, no, F.col("s4")), ("BOARD_ANY_OF", none, F.array(t + 1, t, t + 2), none), ("RIDE_TO_STATION", none, no, F.col("s9"))]
    steps = F.array(*(F.struct(F.lit(k).alias("step_index"), F.lit(a).alias("type"), b.cast("int").alias("until"), c.alias("trains"), d.cast("int").alias("target")) for k, (a, b, c, d) in enumerate(plan, 1)))
    return players, trips.select(m, role, F.explode(steps).alias("s")).select("match_id", "role", "s.*")


def _played(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    visits = stop_times(read(spark, sf_dir, "events"))
    players, steps = cast(visits)
    return players, steps, resolved(players, steps, visits)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(*_played(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, _, done = _played(spark, sf_dir)
    return match_log(players, done)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _played(spark, sf_dir)[2].where("error is not null").select(*PLAYER, "step_index", "error", F.col("begin").alias("minute"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    players, steps, done = _played(spark, sf_dir)
    prefix = done.where("error is null").groupBy(*PLAYER).agg(F.max("step_index").alias("prefix"))
    marked = steps.join(prefix, PLAYER, "left")
    return marked.select(*PLAYER, "step_index", F.when(F.col("step_index") <= F.coalesce("prefix", F.lit(0)), "DONE").otherwise("NEXT").alias("mark"))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans of every match as far as 3000 minutes after its start."""
    players, _, done = _played(spark, sf_dir)
    return previewed(players, done, F.col("minute") + 3000)


def _pass_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip's first station is ridden to again: to the second visit by even trips, to the third by odd ones."""
    visits = stop_times(read(spark, sf_dir, "events"))
    home = visits.where("seq = 1").select(F.col("trip_id").alias("match_id"), F.lit(0).alias("role"), "station_id", "minute")
    none = F.lit(None).cast("int")
    step = lambda k, t, trains, target, n: F.struct(F.lit(k).alias("step_index"), F.lit(t).alias("type"), none.alias("until"), trains.cast("array<long>").alias("trains"), target.cast("int").alias("target"), n.cast("int").alias("loop_pass"))
    steps = home.select("match_id", "role", F.inline(F.array(step(1, "BOARD_TRAIN", F.array("match_id"), none, none), step(2, "RIDE_TO_STATION", F.lit(None), F.col("station_id"), 2 + F.col("match_id") % 2))))
    done = resolved(home, steps, visits).where("type = 'RIDE_TO_STATION'")
    return done.select(F.col("match_id").alias("trip_id"), F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("end", F.lit(-1)).alias("minute"), F.coalesce("error", F.lit("")).alias("error"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every candidate of a choice of trains: unknown, not to be caught, taken, or not needed after that."""
    visits = stop_times(read(spark, sf_dir, "events"))
    third = visits.where("seq = 3").select(F.col("trip_id").alias("asker"), F.col("station_id").alias("here"), F.col("minute").alias("now"))
    wish = third.select("asker", "here", "now", F.posexplode(F.array(F.col("asker") + 1, F.col("asker") + 100000000, F.col("asker"), F.col("asker") + 2)).alias("p", "candidate"))
    known = visits.select(F.col("trip_id").alias("candidate")).distinct().withColumn("known", F.lit(True))
    stops = visits.select(F.col("trip_id").alias("candidate"), F.col("station_id").alias("here"), "dep")
    got = wish.join(stops, ["candidate", "here"]).where(F.col("dep") >= F.col("now")).groupBy("asker", "p").agg(F.min("dep").alias("dep"))
    rows = wish.join(known, "candidate", "left").join(got, ["asker", "p"], "left")
    taken = F.min(F.when(F.col("dep").isNotNull(), F.col("p"))).over(Window.partitionBy("asker"))
    outcome = F.when(F.col("known").isNull(), "unknown_train").when(F.col("dep").isNull(), "not_catchable_from_current_state").when(F.col("p") == taken, "chosen").otherwise("not_needed")
    return rows.select(F.col("asker").alias("trip_id"), (F.col("p") + 1).alias("pos"), "candidate", outcome.alias("outcome"), F.coalesce("dep", F.lit(-1)).alias("dep"))


def _seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(_preview(spark, sf_dir), F.col("match_id") % 2 == 1)


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_log(spark, sf_dir), stop_times(read(spark, sf_dir, "events")))


QUERIES = {
    "seat_projection": _seats,
    "replay_positions": _replay,
    "plan_intervals": _spans,
    "plan_errors": _errors,
    "plan_marks": _marks,
    "match_event_log": _log,
    "interval_overlap_first_capture": lambda spark, sf_dir: overlaps(_spans(spark, sf_dir)),
    "capture_minute_sampled": lambda spark, sf_dir: sampled(_spans(spark, sf_dir)),
    "plan_preview": _preview,
    "loop_pass_rides": _pass_rides,
    "board_any_of_choice": _choices,
}

_CHAIN = f"""v AS (SELECT * FROM {SQL['st']}),
p AS (SELECT trip_id AS t, trip_id // 2 AS m, CAST(trip_id % 2 AS INTEGER) AS role, station_id AS home, minute AS t0, min(minute) OVER (PARTITION BY trip_id // 2) AS start FROM v WHERE seq = 1),
x AS (SELECT trip_id // 2 AS m, max(dep) + 100 AS fin FROM v GROUP BY 1),
g AS (SELECT p.*, fin, a.station_id AS s4, b.station_id AS s9 FROM p JOIN x USING (m) LEFT JOIN v a ON a.trip_id = t AND a.seq = 4 LEFT JOIN v b ON b.trip_id = t AND b.seq = 9),
b1 AS (SELECT t, min(dep) AS d1, arg_min(seq, CAST(dep AS BIGINT) * 1000000 + seq) AS q1 FROM g JOIN v ON trip_id = t AND station_id = home AND dep >= t0 WHERE t % 7 <> 3 GROUP BY t),
r1 AS (SELECT t, arg_min(minute, seq) AS a1 FROM g JOIN b1 USING (t) JOIN v ON trip_id = t AND station_id = s4 AND seq > q1 GROUP BY t),
c2 AS (SELECT t, k, trip_id AS c, min(dep) AS d2, arg_min(seq, CAST(dep AS BIGINT) * 1000000 + seq) AS q2 FROM g JOIN r1 USING (t) CROSS JOIN (VALUES (1, 1), (2, 0), (3, 2)) w(k, plus) JOIN v ON trip_id = t + plus AND station_id = s4 AND dep >= a1 GROUP BY t, k, trip_id),
b2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY t ORDER BY k) = 1),
r2 AS (SELECT t, arg_min(minute, seq) AS a2 FROM g JOIN b2 USING (t) JOIN v ON trip_id = c AND station_id = s9 AND seq > q2 GROUP BY t),
f AS (SELECT g.*, d1, a1, c, k, d2, a2 FROM g LEFT JOIN b1 USING (t) LEFT JOIN r1 USING (t) LEFT JOIN b2 USING (t) LEFT JOIN r2 USING (t)),
i AS (SELECT m, role, 'NODE' AS kind, home AS place, start AS b, t0 AS e FROM f UNION ALL SELECT m, role, 'NODE', home, t0, d1 FROM f WHERE d1 > t0 UNION ALL SELECT m, role, 'TRAIN', t, d1, a1 FROM f WHERE a1 IS NOT NULL
  UNION ALL SELECT m, role, 'NODE', s4, a1, d2 FROM f WHERE d2 > a1 UNION ALL SELECT m, role, 'TRAIN', c, d2, a2 FROM f WHERE a2 IS NOT NULL UNION ALL SELECT m, role, 'NODE', s9, a2, fin FROM f WHERE a2 < fin)"""
_MET = """SELECT m AS match_id, minute, kind, place FROM (SELECT r.m, greatest(r.b, h.b) AS minute, r.kind, r.place, row_number() OVER (PARTITION BY r.m ORDER BY greatest(r.b, h.b), r.kind DESC, r.place) AS n
  FROM i r JOIN i h ON r.role = 0 AND h.role = 1 AND r.m = h.m AND r.kind = h.kind AND r.place = h.place AND r.b {0} h.e AND h.b {0} r.e) WHERE n = 1"""
_LEFT = "CASE WHEN d1 IS NULL THEN 1 WHEN a1 IS NULL THEN 2 WHEN c IS NULL THEN 3 WHEN a2 IS NULL THEN 4 ELSE 5 END"
ORACLE = {
    "plan_intervals": f"WITH {_CHAIN} SELECT m AS match_id, role, kind, CAST(place AS BIGINT) AS place, b AS begin, e AS end FROM i",
    "plan_errors": f"""WITH {_CHAIN} SELECT m AS match_id, role, {_LEFT} + 1 AS step_index, ['not_catchable_from_current_state', 'station_not_reached', 'not_catchable_from_current_state', 'station_not_reached'][{_LEFT}] AS error,
  CASE {_LEFT} WHEN 1 THEN t0 WHEN 2 THEN d1 WHEN 3 THEN a1 ELSE d2 END AS minute FROM f WHERE a2 IS NULL""",
    "plan_marks": f"WITH {_CHAIN} SELECT m AS match_id, role, CAST(s AS INTEGER) AS step_index, CASE WHEN s <= {_LEFT} THEN 'DONE' ELSE 'NEXT' END AS mark FROM f CROSS JOIN range(1, 6) r(s)",
    "match_event_log": f"""WITH {_CHAIN}, n AS (SELECT *, CASE WHEN role = 0 THEN 'runner' ELSE 'hunter' END AS who FROM f),
z AS (SELECT m, start AS minute, 0 AS o, 'SCENARIO_START' AS type, '' AS who, NULL AS loc, -1 AS s FROM n WHERE role = 0 UNION ALL SELECT m, start, 1, 'START_AT_STATION', who, 'N' || home, 0 FROM n UNION ALL SELECT m, t0, 2, 'WAIT_UNTIL', who, 'N' || home, 1 FROM n
  UNION ALL SELECT m, d1, 4, 'BOARD_TRAIN', who, 'T' || t, 2 FROM n WHERE d1 IS NOT NULL UNION ALL SELECT m, a1, 5, 'ALIGHT_TRAIN', who, 'N' || s4, 3 FROM n WHERE a1 IS NOT NULL UNION ALL SELECT m, a1, 3, 'PLAN_RESOLUTION', who, NULL, 4 FROM n WHERE c IS NOT NULL
  UNION ALL SELECT m, d2, 4, 'BOARD_TRAIN', who, 'T' || c, 4 FROM n WHERE c IS NOT NULL UNION ALL SELECT m, a2, 5, 'ALIGHT_TRAIN', who, 'N' || s9, 5 FROM n WHERE a2 IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY minute, o, who, s) AS pos FROM z),
q AS (SELECT y.*, (SELECT coalesce((SELECT loc FROM y u WHERE u.m = y.m AND u.pos <= y.pos AND u.who = 'runner' AND u.loc IS NOT NULL ORDER BY u.pos DESC LIMIT 1), 'N' || (SELECT home FROM f WHERE f.m = y.m AND role = 0))) AS runner,
  (SELECT coalesce((SELECT loc FROM y u WHERE u.m = y.m AND u.pos <= y.pos AND u.who = 'hunter' AND u.loc IS NOT NULL ORDER BY u.pos DESC LIMIT 1), 'N' || (SELECT home FROM f WHERE f.m = y.m AND role = 1))) AS hunter FROM y),
k AS (SELECT m, min(pos) AS cap FROM q WHERE runner = hunter AND o IN (0, 1, 4, 5) GROUP BY m),
l AS (SELECT q.*, cap FROM q LEFT JOIN k USING (m) WHERE cap IS NULL OR pos <= cap),
w AS (SELECT m, pos, minute, type, who, runner, hunter FROM l UNION ALL SELECT m, max(pos) + 1, CASE WHEN max(cap) IS NULL THEN (SELECT max(fin) FROM f WHERE f.m = l.m) ELSE arg_max(minute, pos) END, CASE WHEN max(cap) IS NULL THEN 'SCENARIO_END' ELSE 'CAPTURE' END, '', arg_max(runner, pos), arg_max(hunter, pos) FROM l GROUP BY m)
SELECT m AS match_id, pos, CAST(minute AS BIGINT) AS minute, type, CASE WHEN who = '' THEN '-' ELSE who END AS player, runner, hunter, CASE WHEN who = '' THEN 'MATCH_GLOBAL' ELSE 'PLAYER_LOCAL' END AS scope, CASE WHEN who = '' THEN 'match' ELSE who END AS lane,
  CASE type WHEN 'CAPTURE' THEN 'RESOLUTION' WHEN 'PLAN_RESOLUTION' THEN 'PLANNING' WHEN 'BOARD_TRAIN' THEN 'MOVEMENT' WHEN 'ALIGHT_TRAIN' THEN 'MOVEMENT' WHEN 'WAIT_UNTIL' THEN 'POSITION' WHEN 'START_AT_STATION' THEN 'POSITION' ELSE 'LIFECYCLE' END AS family FROM w""",
    "interval_overlap_first_capture": f"WITH {_CHAIN} {_MET.format('<=')}",
    "capture_minute_sampled": f"WITH {_CHAIN} {_MET.format('<')}",
    "plan_preview": f"""WITH {_CHAIN}, w AS (SELECT *, start + 3000 AS cap, CASE WHEN d1 IS NULL THEN 'not_catchable_from_current_state' WHEN a1 IS NULL THEN 'station_not_reached' WHEN c IS NULL THEN 'not_catchable_from_current_state' WHEN a2 IS NULL THEN 'station_not_reached' END AS err,
  CASE WHEN d1 IS NULL THEN t0 WHEN a1 IS NULL THEN d1 WHEN c IS NULL THEN a1 WHEN a2 IS NULL THEN d2 END AS since FROM f),
n AS (SELECT *, CASE WHEN a2 <= cap THEN 5 WHEN d2 <= cap THEN 4 WHEN a1 <= cap THEN 3 WHEN d1 <= cap THEN 2 WHEN t0 <= cap THEN 1 ELSE 0 END AS k9 FROM w)
SELECT m AS match_id, role, CAST(k9 AS INTEGER) AS steps, [start, t0, d1, a1, d2, a2][k9 + 1] AS minute, CASE WHEN k9 IN (2, 4) THEN 'TRAIN' ELSE 'NODE' END AS kind, CAST([home, home, t, s4, c, s9][k9 + 1] AS BIGINT) AS place, CASE WHEN since <= cap THEN err END AS error FROM n""",
    "loop_pass_rides": f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY trip_id, station_id ORDER BY seq) AS pass FROM {SQL['st']}),
b AS (SELECT h.trip_id, h.station_id, arg_min(o.seq, CAST(o.dep AS BIGINT) * 1000000 + o.seq) AS on_seq FROM v h JOIN v o USING (trip_id, station_id) WHERE h.seq = 1 AND o.dep >= h.minute GROUP BY 1, 2)
SELECT b.trip_id, coalesce(v.seq, -1) AS seq, coalesce(v.minute, -1) AS minute, CASE WHEN v.seq IS NULL THEN 'station_not_reached' ELSE '' END AS error FROM b LEFT JOIN v ON v.trip_id = b.trip_id AND v.station_id = b.station_id AND v.seq > on_seq AND v.pass = 2 + b.trip_id % 2""",
    "board_any_of_choice": f"""WITH v AS (SELECT * FROM {SQL['st']}), w AS (SELECT trip_id, station_id, minute, unnest([1, 2, 3, 4]) AS pos, unnest([trip_id + 1, trip_id + 100000000, trip_id, trip_id + 2]) AS candidate FROM v WHERE seq = 3),
d AS (SELECT w.*, (SELECT min(dep) FROM v WHERE v.trip_id = candidate AND v.station_id = w.station_id AND dep >= w.minute) AS dep FROM w)
SELECT trip_id, pos, candidate, CASE WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.trip_id = candidate) THEN 'unknown_train' WHEN dep IS NULL THEN 'not_catchable_from_current_state' WHEN EXISTS (SELECT 1 FROM d o WHERE o.trip_id = d.trip_id AND o.pos < d.pos AND o.dep IS NOT NULL) THEN 'not_needed' ELSE 'chosen' END AS outcome, coalesce(dep, -1) AS dep FROM d""",
}
ORACLE["seat_projection"] = f"""WITH w0 AS ({ORACLE['plan_preview']}), r AS (SELECT a.match_id, a.role AS viewer, b.role AS target, CASE WHEN a.role = b.role THEN 'full' WHEN a.match_id % 2 = 1 THEN 'hidden' WHEN b.kind = 'NODE' THEN 'station' ELSE 'segment' END AS visibility, b.kind AS k, b.place AS p FROM w0 a JOIN w0 b USING (match_id))
SELECT match_id, viewer, target, visibility, CASE WHEN visibility = 'hidden' THEN 'HIDDEN' ELSE k END AS kind, CASE WHEN visibility IN ('full', 'station') THEN p END AS place FROM r"""
ORACLE["replay_positions"] = f"""WITH l0 AS ({ORACLE['match_event_log']}), b0 AS (SELECT match_id, pos, minute, 'runner' AS player, runner AS loc FROM l0 UNION ALL SELECT match_id, pos, minute, 'hunter', hunter FROM l0),
p0 AS (SELECT *, CASE WHEN loc[1] = 'T' THEN 'TRAIN' ELSE 'NODE' END AS kind, loc[2:]::BIGINT AS place FROM b0),
v0 AS (SELECT *, lead(station_id) OVER w AS nxt, lead(minute) OVER w AS arr FROM {SQL['st']} WINDOW w AS (PARTITION BY trip_id ORDER BY seq)), d0 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY trip_id, minute ORDER BY seq DESC) = 1)
SELECT match_id, pos, player, kind, place, CASE WHEN kind = 'NODE' THEN place::INTEGER ELSE d0.station_id END AS from_station, nxt AS to_station, CASE WHEN nxt IS NULL THEN NULL WHEN p0.minute <= d0.dep THEN 0.0 WHEN arr - d0.dep < 1 THEN 1.0 ELSE least((p0.minute - d0.dep) / (arr - d0.dep), 1.0) END::DOUBLE AS progress
FROM p0 ASOF LEFT JOIN d0 ON d0.trip_id = CASE WHEN kind = 'TRAIN' THEN place END AND p0.minute >= d0.minute"""
