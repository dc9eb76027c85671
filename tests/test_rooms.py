"""The command log of rooms: rules by hand, and state kept over batches."""

from collections import Counter

import pytest

from loomrail.streaming import room_commands as rooms

SF = "/root/testdata/sf0.001"


def played(commands, pace=1):
    room, out = None, []
    for now, command, seat, token, *value in commands:
        room, outcome = rooms.obey(room, command, seat, token, value[0] if value else None, now, pace)
        out.append((outcome, room and room.phase, room and room.minute))
    return out


def test_rules_by_hand():
    both = [(0, "create", "", ""), (1, "join", "runner", "a"), (2, "join", "hunter", "b")]
    assert played([(0, "join", "runner", "a"), (1, "create", "", ""), (2, "create", "", ""), (3, "join", "runner", "a"), (4, "join", "runner", "x"), (5, "join", "runner", "a"), (6, "ready", "hunter", "b"), (7, "plan", "runner", "x"), (8, "dance", "runner", "a"), (9, "join", "dog", "d")]) == [
        ("no_room", None, None), ("ok", "PLANNING", 360), ("room_exists", "PLANNING", 360), ("ok", "PLANNING", 360), ("seat_occupied", "PLANNING", 360), ("ok", "PLANNING", 360), ("invalid_token", "PLANNING", 360), ("invalid_token", "PLANNING", 360), ("unknown_command", "PLANNING", 360), ("no_seat", "PLANNING", 360)]
    # both ready: a minute of planning at most; both ready again, or the time being over: the game runs
    ready = both + [(3, "ready", "runner", "a"), (4, "ready", "hunter", "b")]
    assert played(ready + [(10, "ready", "runner", "a"), (11, "start", "hunter", "b"), (31, "plan", "hunter", "b")])[-3:] == [("ok", "PLANNING", 360), ("ok", "LIVE", 360), ("ok", "LIVE", 380)]
    assert played(ready + [(63, "plan", "runner", "a"), (64, "plan", "runner", "a"), (70, "plan", "runner", "a")])[-3:] == [("ok", "PLANNING", 360), ("ok", "LIVE", 360), ("ok", "LIVE", 366)]
    # starting alone starts nothing; an hour of the game ends in planning again, and the day ends the match
    assert played(both + [(3, "start", "runner", "a"), (4, "start", "hunter", "b")])[-1] == ("ok", "PLANNING", 360)
    live = ready + [(10, "ready", "runner", "a"), (11, "ready", "hunter", "b")]
    assert played(live + [(500, "plan", "runner", "a"), (559, "plan", "runner", "a"), (560, "plan", "runner", "a"), (565, "plan", "runner", "a")])[-4:] == [("ok", "PLANNING", 420), ("ok", "PLANNING", 420), ("ok", "LIVE", 420), ("ok", "LIVE", 425)]
    room = [(t, "plan", "runner", "a") for t in range(500, 3000, 60)]
    assert played(live + room)[-1] == ("ok", "ENDED", 1080)
    # a meeting ends the game at its minute, at once where they begin together
    meet = lambda m: [(0, "create", "", "", m)] + live[1:]
    assert played(meet(375) + [(20, "plan", "runner", "a"), (40, "plan", "runner", "a")])[-2:] == [("ok", "LIVE", 369), ("ok", "ENDED", 375)]
    assert played(meet(360))[-1] == ("ok", "ENDED", 360)
    assert played(meet(360) + [(99, "create", "", "", None)])[-1] == ("ok", "PLANNING", 360)


@pytest.fixture
def store(spark):
    before = spark.conf.get(rooms.PROVIDER)
    spark.conf.set(rooms.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(rooms.PROVIDER, before)


def test_state_lasts_over_batches(spark, store, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").limit(400).toPandas()
    for k in range(4):
        spark.createDataFrame(events.iloc[k * 100 : (k + 1) * 100]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    # a command of a batch long gone comes again at the end
    spark.createDataFrame(events.iloc[5:6]).coalesce(1).write.parquet(str(tmp_path / "in" / "4"))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    rows = {}
    for name, least in (("split", 1), ("whole", 1000)):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", least).parquet(str(tmp_path / "in" / "*"))
        run = rooms.outcomes(rooms.commands_of(source)).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        run.awaitTermination()
        rows[name] = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())
    late = [r for r in rows["split"] if r[4] == "late"]
    assert [r[1] for r in late] == [int(events.event_id[5])]
    assert [r[1:5] for r in rows["split"] if r[4] != "late"] == [r[1:5] for r in rows["whole"] if r[4] != "late"]


def test_all_outcomes_come_up(spark):
    rows = rooms.query(spark, "/root/testdata/sf0.01").select("outcome", "phase").collect()
    assert set(Counter(r["outcome"] for r in rows)) == {"ok", "no_room", "room_exists", "seat_occupied", "invalid_token"}
    assert set(Counter(r["phase"] for r in rows)) == {"NONE", "PLANNING", "LIVE", "ENDED"}
