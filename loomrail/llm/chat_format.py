"""Multi-party chat rendered from every participant's side; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.llm.common import table

#: Turns whose lengths are summed together before those of single turns are.
BLOCK = 1024
#: The speaker who is nobody's counterpart.
SYSTEM = "system"


def escaped(text: Column) -> Column:
    """Text that holds no marker: every <| gets a backslash between, one more than it had, so that it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    r"""A name that ends no header: backslash, bar and line ends as \\, \b, \n and \r."""
    for old, new in (("\\", "\\\\"), ("|", "\\b"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, speaker, pos, turn, as_role, segment, start_at, end_at, learn_at), a row for each message of each rendering.

    For every participant but the system, the conversation is rendered with that participant as
    assistant and all others as users under their names; segments in order of pos, put together, are
    the rendering, and [start_at, end_at) is a segment's place in it in characters. [learn_at, end_at)
    is what the participant's model learns: its own words and their end mark, not the header that
    asks for them; in others' messages it is empty (learn_at = end_at). Texts and names are escaped, so that no
    message can forge a turn. Messages go by turn (null last), then by a hash of the text, speaker
    (null last) and text, so repeated rows stay and keep a fixed order. A null speaker takes part as
    a participant without a name, apart from any named one; a null text is empty. A null conversation
    is a conversation. Conversations in which only the system speaks have no rendering. Columns
    besides the four are not read.

    Equal messages are counted first, and lengths are summed by blocks of turns, by turn and by hash,
    so that no task needs more of a conversation than one turn's messages of one hash.
    """
    said = F.coalesce(F.col(text_col), F.lit(""))
    plain = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("name"), said.alias("text"))
    rows = plain.groupBy("conv_id", "turn", "name", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("part", F.substring(F.md5(F.col("text").cast("binary")), 1, 3)).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(1 << 62)))
    speakers = plain.where(~F.col("name").eqNullSafe(F.lit(SYSTEM))).select(F.col("conv_id").alias("_conv"), F.col("name").alias("speaker")).distinct()
    both = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("name").eqNullSafe(F.col("speaker"))
    as_role = F.when(own, "assistant").when(F.col("name") == SYSTEM, "system").otherwise("user")
    named = F.when((F.col("as_role") == "user") & F.col("name").isNotNull(), F.concat(F.lit(" name="), escaped_name(F.col("name")))).otherwise("")
    head = F.concat(F.lit("<|"), "as_role", named, F.lit("|>\n"))
    shown = both.withColumn("as_role", as_role).withColumn("own", own).withColumn("head", head).withColumn("segment", F.concat("head", escaped(F.col("text")), F.lit("<|end|>\n")))
    shown = shown.withColumn("size", F.char_length("segment").cast("long")).withColumn("lead", F.when(F.col("own"), F.char_length("head").cast("long")).otherwise(F.col("size"))).drop("head", "own", "text")
    # sums by block, by turn in it, and by part of that
    total = (F.sum(F.col("size") * F.col("copies")).alias("chars"), F.sum("copies").alias("messages"))
    parts = shown.groupBy("conv_id", "speaker", "block", "turn", "part").agg(*total)
    blocks = parts.groupBy("conv_id", "speaker", "block").agg(F.sum("chars").alias("chars"), F.sum("messages").alias("messages"))
    in_block = Window.partitionBy("conv_id", "speaker", "block").orderBy(F.col("turn").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)
    in_whole = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    other = lambda df, *keys: df.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in df.columns if c not in (*keys, "chars", "messages")))
    same = lambda *keys: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    first = other(blocks.withColumns({"chars0": upto("chars", in_whole), "messages0": upto("messages", in_whole)}), "conv_id", "speaker", "block")
    keys = ("conv_id", "speaker", "block", "turn", "part")
    inner = parts.withColumns({"chars1": upto("chars", in_block), "messages1": upto("messages", in_block)}).drop("chars", "messages")
    before = inner.join(first, same(*keys[:3])).select(*keys, (F.col("chars0") + F.col("chars1")).alias("chars"), (F.col("messages0") + F.col("messages1")).alias("messages"))
    before = before.select(*(F.col(k).alias(f"_{k}") for k in keys), "chars", "messages")
    placed = shown.join(before, same(*keys))
    order = Window.partitionBy(*keys).orderBy(F.col("name").asc_nulls_last(), "segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("chars") + upto(F.col("size") * F.col("copies"), order)
    counted = placed.withColumn("start", start).withColumn("number", F.col("messages") + upto("copies", order)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = F.col("start") + F.col("k") * F.col("size")
    return counted.select("conv_id", "speaker", (F.col("number") + F.col("k") + 1).alias("pos"), "turn", "as_role", "segment", at.alias("start_at"), (at + F.col("size")).alias("end_at"), (at + F.col("lead")).alias("learn_at"))


def renderings(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, speaker, rendering, masks): whole renderings, each with the ranges to learn from, for conversations that fit in a row."""
    rows = perspectives(turns, **columns).groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("pos", "segment", "learn_at", "end_at"))).alias("m"))
    return rows.select("conv_id", "speaker", F.array_join(F.col("m.segment"), "").alias("rendering"), F.transform(F.filter("m", lambda x: x["learn_at"] < x["end_at"]), lambda x: F.struct(x["learn_at"].alias("start_at"), x["end_at"].alias("end_at"))).alias("masks"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role AS name, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name IS DISTINCT FROM 'system'),
j AS (SELECT t.*, p.speaker, name IS NOT DISTINCT FROM speaker AS own, replace(replace(replace(replace(name, '\', '\\'), '|', '\b'), chr(10), '\n'), chr(13), '\r') AS shown
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN own THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END AS as_role,
             CASE WHEN own THEN '<|assistant|>' WHEN name = 'system' THEN '<|system|>' WHEN name IS NULL THEN '<|user|>' ELSE concat('<|user name=', shown, '|>') END || chr(10) AS head FROM j),
s AS (SELECT *, head || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS segment FROM h)
SELECT conv_id, speaker, row_number() OVER w AS pos, turn, as_role, segment,
       CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(segment) AS BIGINT) AS start_at,
       CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_at,
       CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN own THEN length(segment) - length(head) ELSE 0 END AS BIGINT) AS learn_at
FROM s WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, substr(md5(text), 1, 3), name NULLS LAST, segment)
"""
