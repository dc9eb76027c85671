"""The timetable queries: each is one SQL text over canonical tables, planned by Catalyst, and run as it is by the yard-stick engine.

Where the two dialects differ a text has [[Spark||other]].
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomrail.operators import boarding, bundle, datasets, geo, labels, maps, markup, merging, network, pursuit, scenario, tiles, timejoins, timetable_pages, validation
from loomrail.sources import archives
from loomrail.sources.adapters import SQL, canonical
from loomrail.streaming import room_clock, room_commands

#: Modules whose queries are DataFrame operations, each with SQL of its own that states the result in another way.
FRAMES = (timetable_pages, datasets, validation, scenario, maps, tiles, labels, timejoins, bundle, archives)
TEXTS = {k: v for m in (boarding, merging, network, pursuit, geo, markup) for k, v in m.QUERIES.items()}
CHOICE = re.compile(r"\[\[(.*?)\|\|(.*?)\]\]", re.S)
FIELD = re.compile(r"(?<!\{)\{(\w+)\}")


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = CHOICE.sub(r"\1", TEXTS[name])
    return spark.sql(text, **canonical(spark, sf_dir, set(FIELD.findall(text))))


def other(name: str) -> str:
    text = CHOICE.sub(r"\2", TEXTS[name])
    return text.format(**{n: SQL.get(n, n) for n in FIELD.findall(text)})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{n: (lambda spark, sf_dir, n=n: run(spark, sf_dir, n)) for n in TEXTS}, **{k: q for m in FRAMES for k, q in m.QUERIES.items()}, "room_clock_stream": room_clock.query, "room_commands": room_commands.query}


def oracle_sql() -> dict[str, str]:
    return {**{n: other(n) for n in TEXTS}, **{k: q for m in FRAMES for k, q in m.ORACLE.items()}, "room_clock_stream": room_clock.ORACLE, "room_commands": room_commands.ORACLE}
