"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.llm.common import WORD, checkpointed, numbered, table

#: Weights by rank of the source, repeating; a source is taken this many times at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of the 32-bit hash that each level of histograms resolves.
LEVELS = (12, 10, 10)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, size, hash): size counts words, hash is 32 bits of the id's MD5 (a null id hashes as empty text)."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null")).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long").alias("hash"),
    )


def targets(rows: DataFrame, budget: float = 1.0, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target): water filling of budget * total over the sources, one row each.

    Sources rank by code point, null last. A target stops at `most` times its source's size; what
    is left over goes to the others by weight, so that in the end target = weight * level below the caps.
    """
    one = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ranked = one.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", "weight", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    level = (budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the first source that the level does not fill fixes the level
    filled = ranked.withColumn("level", level).withColumn("stop", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"])
    return filled.select("key", "source_size", F.round(F.least("cap", F.coalesce(F.col("weight") * F.col("stop"), "cap")), 6).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, levels: tuple = LEVELS) -> DataFrame:
    """(key, target, threshold, ...) with hashes below threshold summing to about `rest` words in each source.

    wanted: (key, budget, rest, ...). Words are summed by source and leading bits of the hash; the
    bucket in which the running sum passes `rest` is the only one that the next level reads again.
    At the last level the nearer edge of the bucket is taken. Several budgets of one source use the
    same hashes, so a smaller budget's documents are among a larger one's.
    """
    found = wanted.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    done = 0
    for bits in levels:
        done += bits
        bucket = F.shiftright("hash", 32 - done)
        part = rows.select("key", "size", bucket.alias("bucket"))
        sums = part.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.shiftright(F.first("bucket"), bits).alias("prefix"))
        # only buckets within a boundary of the level before
        hit = sums.join(found, ["key", "prefix"])
        run = F.sum("words").over(Window.partitionBy("key", "budget").orderBy("bucket"))
        upto = hit.withColumn("upto", F.col("before") + run)
        first = upto.where(F.col("upto") >= F.col("rest")).groupBy("key", "budget").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        found = checkpointed(found.drop("prefix", "before").join(first, ["key", "budget"]).select(*wanted.columns, F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("before"), F.col("b.upto").alias("after")))
        if done < sum(levels):
            found = found.drop("after")
    edge = F.when(F.col("after") - F.col("rest") <= F.col("rest") - F.col("before"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return found.withColumn("threshold", edge).drop("prefix", "before", "after")


def mixed(docs: DataFrame, budget: float = 1.0, weights: tuple = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    taken = size * copies; a source whose target is t times its size gives every document floor(t)
    times and those below the threshold once more. Null and empty texts have size 0; rows with equal
    ids share one fate; a null source is a source. Reruns agree, as the hash is of the id alone.
    """
    rows = checkpointed(sized(docs, id_col, text_col, source_col))
    goal = checkpointed(targets(rows, budget, weights, most))
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0))
    wanted = goal.withColumn("times", times).withColumn("budget", F.lit(0)).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    limit = thresholds(rows, wanted.where("rest > 0")).select("key", "threshold")
    plan = checkpointed(wanted.join(limit, "key", "left").select("key", "source_size", "target", "times", F.coalesce("threshold", F.lit(0)).alias("threshold")))
    copies = F.col("times") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return rows.join(plan, "key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents without a word go by their copies too.

    All columns pass through, whatever their names.
    """
    rows, (i, t, s) = numbered(docs, id_col, text_col, source_col)
    # ids that several rows share have the same number of copies within one source
    plan = mixed(rows, id_col=i, text_col=t, source_col=s).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("copies").alias("_copies")).distinct()
    joined = rows.join(plan, F.col(i).eqNullSafe(F.col("_id")) & F.col(s).eqNullSafe(F.col("_source")))
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*rows.columns).toDF(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY source),
r AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
c AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / w AS fill FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY fill, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT level AS stop FROM l WHERE level <= fill ORDER BY fill, level LIMIT 1),
g AS (SELECT source, source_size, round(least(cap, coalesce(w * (SELECT stop FROM m), cap)), 6) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS times FROM g),
b AS (SELECT t.source, t.h, sum(t.size) AS words FROM t GROUP BY t.source, t.h),
u AS (SELECT b.*, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (SELECT u.source, min(h) AS h FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source
      WHERE target - times * source_size > 0 AND upto >= target - times * source_size GROUP BY u.source),
f AS (SELECT e.source, CASE WHEN u.upto - (target - times * source_size) <= (target - times * source_size) - (u.upto - u.words) THEN e.h + 1 ELSE e.h END AS threshold
      FROM e JOIN u ON u.source IS NOT DISTINCT FROM e.source AND u.h = e.h JOIN p ON p.source IS NOT DISTINCT FROM e.source)
SELECT t.doc_id, t.size, p.source_size, p.target, CAST(t.size * (times + CASE WHEN t.h < coalesce(f.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source LEFT JOIN f ON t.source IS NOT DISTINCT FROM f.source
"""
