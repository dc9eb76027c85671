"""The command log of live rooms: a stream of commands becomes the outcome of each, by the state that its room has kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomrail.sources.storage import new_folder

# A day's first and last minute, minutes between plannings, and how many minutes of the clock a planning lasts at most.
START, END, HOUR, PLANNING = 360, 1080, 60, 60
SEATS = ("runner", "hunter")
#: Real seconds for a minute of the game; 1 in a live room, more where commands are further apart.
PACE = 600


@dataclass
class Room:
    phase: str = "PLANNING"
    minute: int = START
    next_planning: int = START + HOUR
    end: int = END
    #: the first minute at which the two meet by their plans, if they do
    meeting: int | None = None
    started: bool = False
    since: int = 0
    deadline: int | None = None
    runner: str | None = None
    hunter: str | None = None
    runner_ready: bool = False
    hunter_ready: bool = False
    #: time and id of the last command
    last_time: int = -1
    last_id: int = -1


STATE = "phase string, minute int, next_planning int, end int, meeting int, started boolean, since bigint, deadline bigint, runner string, hunter string, runner_ready boolean, hunter_ready boolean, last_time bigint, last_id bigint"
OUTCOME = "room_id bigint, command_id bigint, command string, seat string, outcome string, phase string, minute int, runner_ready boolean, hunter_ready boolean"


def live(room: Room, now: int) -> Room:
    """The game runs from now on, unless the two stand in one place already."""
    return replace(room, phase="ENDED" if room.meeting == room.minute else "LIVE", since=now, deadline=None)


def advanced(room: Room, now: int, pace: int) -> Room:
    """The room as time has brought it on: a planning that has lasted long enough ends; a live room goes on to the next planning, a meeting or the end."""
    if room.phase == "PLANNING" and room.started and room.deadline is not None and now >= room.deadline:
        return live(room, now)
    passed = (now - room.since) // pace
    if room.phase != "LIVE" or passed <= 0:
        return room
    stops = [room.minute + passed, room.end, room.next_planning] + ([room.meeting] if room.meeting is not None and room.meeting > room.minute else [])
    minute = min(stops)
    room = replace(room, minute=minute, since=now)
    if minute == room.meeting or minute >= room.end:
        return replace(room, phase="ENDED")
    if minute >= room.next_planning:
        return replace(room, phase="PLANNING", runner_ready=False, hunter_ready=False, deadline=now + PLANNING * pace, next_planning=min(room.next_planning + HOUR, room.end))
    return room


def obey(room: Room | None, command: str, seat: str, token: str, value: int | None, now: int, pace: int) -> tuple[Room | None, str]:
    """The room after a command, and "ok" or why it was refused; a refused one still lets time pass."""
    if command == "create":
        if room and advanced(room, now, pace).phase != "ENDED":
            return advanced(room, now, pace), "room_exists"
        return Room(meeting=value, since=now), "ok"
    if room is None:
        return None, "no_room"
    room = advanced(room, now, pace)
    if seat not in SEATS:
        return room, "no_seat"
    held = getattr(room, seat)
    if command == "join":
        return (room, "seat_occupied") if held is not None and held != token else (replace(room, **{seat: token}), "ok")
    if held is None or held != token:
        return room, "invalid_token"
    if command == "plan":
        return replace(room, **{f"{seat}_ready": False}), "ok"
    if command not in ("ready", "unready", "start"):
        return room, "unknown_command"
    room = replace(room, **{f"{seat}_ready": command != "unready"})
    if room.runner_ready and room.hunter_ready:
        if not room.started and command != "start":
            room = replace(room, started=True, phase="PLANNING", since=now, deadline=now + PLANNING * pace, runner_ready=False, hunter_ready=False)
        elif room.started and room.phase == "PLANNING":
            room = live(room, now)
    return room, "ok"


class Commands(StatefulProcessor):
    """Each room's commands in the order of their time; one that comes after a later one was obeyed is refused as late."""

    def __init__(self, pace: int) -> None:
        self.pace = pace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("room", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        # a room that was never made keeps the place of its last command only
        room = Room(*kept) if kept is not None else Room(phase="NONE")
        out = []
        for c in pd.concat(list(rows)).sort_values(["seconds", "command_id"]).itertuples():
            value = None if pd.isna(c.value) else int(c.value)
            if (c.seconds, c.command_id) <= (room.last_time, room.last_id):
                outcome = "late"
            else:
                now, outcome = obey(None if room.phase == "NONE" else room, c.command, c.seat, c.token, value, c.seconds, self.pace)
                room = replace(now or room, last_time=int(c.seconds), last_id=int(c.command_id))
            out.append((key[0], c.command_id, c.command, c.seat, outcome, room.phase, room.minute, room.runner_ready, room.hunter_ready))
        self.state.update(astuple(room))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def outcomes(commands: DataFrame, pace: int = PACE) -> DataFrame:
    """(room_id, command_id, command, seat, outcome, phase, minute, runner_ready, hunter_ready) of each command of a stream.

    commands: room_id, command_id, seconds, command, seat, token, value. Commands are create (value is
    the minute of the meeting, if any), join, plan, ready, unready and start. Needs the RocksDB state store.
    """
    return commands.groupBy("room_id").transformWithStateInPandas(statefulProcessor=Commands(pace), outputStructType=OUTCOME, outputMode="Append", timeMode="None")


def commands_of(events: DataFrame) -> DataFrame:
    """Four users share a room, two of them each seat; what they do goes by the event's number."""
    n = F.col("event_id") % 8
    kind = F.element_at(F.array(*map(F.lit, ("create", "join", "join", "plan", "ready", "ready", "start", "unready"))), (n + 1).cast("int"))
    seat = F.when(F.col("user_id") % 2 == 0, "runner").otherwise("hunter")
    value = F.when((n == 0) & (F.col("event_id") % 3 == 0), START + F.col("event_id") % 700)
    return events.select(F.floor(F.col("user_id") / 4).alias("room_id"), F.col("event_id").alias("command_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), kind.alias("command"), seat.alias("seat"), F.col("user_id").cast("string").alias("token"), value.cast("int").alias("value"))


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay the events as commands of rooms, to the end of the file."""
    out = new_folder(spark, "commands")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        run = outcomes(commands_of(stream)).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUTCOME).parquet(f"{out}/data")


ORACLE = """
WITH RECURSIVE c AS (SELECT user_id // 4 AS room, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, ['create', 'join', 'join', 'plan', 'ready', 'ready', 'start', 'unready'][event_id % 8 + 1] AS cmd, user_id % 2 AS s, user_id AS tok,
  CASE WHEN event_id % 24 = 0 THEN 360 + event_id % 700 END AS v, row_number() OVER (PARTITION BY user_id // 4 ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
g AS (SELECT room, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS cmd, NULL::BIGINT AS s, NULL::VARCHAR AS outcome, 'NONE' AS phase, 360::BIGINT AS m, 420::BIGINT AS nxt, NULL::BIGINT AS meet, false AS started, 0::BIGINT AS since, NULL::BIGINT AS dl, NULL::BIGINT AS o0, NULL::BIGINT AS o1, false AS r0, false AS r1 FROM (SELECT DISTINCT room FROM c)
UNION ALL SELECT room, n, id, cmd, s, outcome,
   CASE WHEN made THEN 'PLANNING' WHEN arms THEN 'PLANNING' WHEN goes THEN CASE WHEN meet = m THEN 'ENDED' ELSE 'LIVE' END ELSE phase END,
   CASE WHEN made THEN 360 ELSE m END, CASE WHEN made THEN 420 ELSE nxt END, CASE WHEN made THEN v ELSE meet END, CASE WHEN made THEN false WHEN arms THEN true ELSE started END,
   CASE WHEN made OR arms OR goes THEN t ELSE since END, CASE WHEN made OR goes THEN NULL WHEN arms THEN t + 36000 ELSE dl END,
   CASE WHEN made THEN NULL WHEN outcome = 'ok' AND cmd = 'join' AND s = 0 THEN tok ELSE o0 END, CASE WHEN made THEN NULL WHEN outcome = 'ok' AND cmd = 'join' AND s = 1 THEN tok ELSE o1 END,
   CASE WHEN made OR arms THEN false ELSE q0 END, CASE WHEN made OR arms THEN false ELSE q1 END
 FROM (SELECT *, outcome = 'ok' AND cmd = 'create' AS made, outcome = 'ok' AND cmd IN ('ready', 'unready') AND q0 AND q1 AND NOT started AS arms, outcome = 'ok' AND cmd IN ('ready', 'unready', 'start') AND q0 AND q1 AND started AND phase = 'PLANNING' AS goes
  FROM (SELECT *, CASE WHEN outcome = 'ok' AND s = 0 AND cmd IN ('ready', 'start') THEN true WHEN outcome = 'ok' AND s = 0 AND cmd IN ('plan', 'unready') THEN false ELSE r0 END AS q0,
        CASE WHEN outcome = 'ok' AND s = 1 AND cmd IN ('ready', 'start') THEN true WHEN outcome = 'ok' AND s = 1 AND cmd IN ('plan', 'unready') THEN false ELSE r1 END AS q1
   FROM (SELECT *, CASE WHEN cmd = 'create' THEN CASE WHEN phase IN ('NONE', 'ENDED') THEN 'ok' ELSE 'room_exists' END WHEN phase = 'NONE' THEN 'no_room'
         WHEN cmd = 'join' THEN CASE WHEN own <> tok THEN 'seat_occupied' ELSE 'ok' END WHEN own IS NULL OR own <> tok THEN 'invalid_token' ELSE 'ok' END AS outcome
    FROM (SELECT room, n, id, cmd, s, tok, t, v, CASE WHEN s = 0 THEN o0 ELSE o1 END AS own, o0, o1, started, meet,
          CASE WHEN w THEN CASE WHEN meet = m THEN 'ENDED' ELSE 'LIVE' END WHEN e IS NULL THEN phase WHEN e = meet OR e >= 1080 THEN 'ENDED' WHEN e >= nxt THEN 'PLANNING' ELSE 'LIVE' END AS phase,
          coalesce(e, m) AS m, CASE WHEN e >= nxt AND e < 1080 AND e IS DISTINCT FROM meet THEN least(nxt + 60, 1080) ELSE nxt END AS nxt, CASE WHEN w OR e IS NOT NULL THEN t ELSE since END AS since,
          CASE WHEN w THEN NULL WHEN e >= nxt AND e < 1080 AND e IS DISTINCT FROM meet THEN t + 36000 ELSE dl END AS dl,
          CASE WHEN e >= nxt AND e < 1080 AND e IS DISTINCT FROM meet THEN false ELSE r0 END AS r0, CASE WHEN e >= nxt AND e < 1080 AND e IS DISTINCT FROM meet THEN false ELSE r1 END AS r1
     FROM (SELECT g.*  EXCLUDE (n, id, cmd, s, outcome), c.n, c.id, c.cmd, c.s, c.tok, c.t, c.v, coalesce(phase = 'PLANNING' AND started AND c.t >= dl, false) AS w,
           CASE WHEN phase = 'LIVE' AND (c.t - since) // 600 > 0 THEN least(m + (c.t - since) // 600, 1080, nxt, CASE WHEN meet > m THEN meet ELSE 9999 END) END AS e
      FROM g JOIN c ON c.room = g.room AND c.n = g.n + 1))))))
SELECT room AS room_id, id AS command_id, cmd AS command, CASE WHEN s = 0 THEN 'runner' ELSE 'hunter' END AS seat, outcome, phase, m::INTEGER AS minute, r0 AS runner_ready, r1 AS hunter_ready FROM g WHERE n > 0"""
