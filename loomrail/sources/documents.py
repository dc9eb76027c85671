"""JSON documents, GeoJSON layers and tiles as sources and sinks."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def nested(stops: DataFrame, *keep: str) -> DataFrame:
    """(keep..., train_number, stop_times): the stops of each trip in order, one row a trip."""
    fields = [c for c in stops.columns if c not in ("trip_id", *keep)]
    rows = stops.groupBy("trip_id", *keep).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("stop_times"))
    return rows.select(*keep, F.col("trip_id").cast("string").alias("train_number"), "stop_times")


def write_trains(stops: DataFrame, path: str) -> None:
    """Nested JSON documents, one train a line: train_number and stop_times in order."""
    nested(stops).write.json(path)


class Documents(NamedTuple):
    #: a row for each record, with `path`
    rows: DataFrame
    #: (path, record, reason) of what could not be read; record is null where it is JSON of another kind
    rejected: DataFrame


def forms(spark: SparkSession, path: str) -> DataFrame:
    """(path, whole): whether each file is one document, as its first line that is not blank is no whole JSON value."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0 AND trim(value) <> ''").groupBy("path").agg(F.min_by("value", "at").alias("line"))
    return first.select("path", F.get_json_object("line", "$").isNull().alias("whole"))


def read_documents(spark: SparkSession, path: str, fields: str, root: str | None = None, form: str | None = None) -> Documents:
    """Records of the JSON files at path, whatever their form: one a line, or a file that is one document, indented or not.

    A document may be a record, a list of them, or an object that holds a list of them under `root`.
    form is "lines" or "document" where all files have that form; else each file's first line tells, and
    every file is read in its own way. Broken documents and lines are given as rejected, as are values
    without any of the fields. A file that is one document is read by one task.
    """
    names = StructType.fromDDL(fields).fieldNames()
    schema = f"{fields}, {f'`{root}` array<struct<{fields}>>, ' if root else ''}_broken string"

    def parsed(whole: bool) -> DataFrame:
        rows = spark.read.schema(schema).option("multiLine", whole).option("columnNameOfCorruptRecord", "_broken").json(path)
        return rows.withColumn("path", F.col("_metadata.file_path"))

    if form:
        every = parsed(form == "document")
    else:
        # a row for each file
        kinds = forms(spark, path)
        every = union_all(*(parsed(whole).join(kinds.where(F.col("whole") == whole).select("path"), "path", "left_semi") for whole in (False, True)))
    record = F.struct(*names)
    some = F.lit(False)
    for n in names:
        some = some | F.col(n).isNotNull()
    held = F.when(F.col("_broken").isNotNull(), None).when(some, F.array(record))
    held = F.coalesce(held, F.when(F.col("_broken").isNull(), F.col(root))) if root else held
    read = every.select("path", "_broken", held.alias("held"))
    reason = F.when(F.col("_broken").isNotNull(), "broken").otherwise("other")
    return Documents(read.select("path", F.inline("held")), read.where("held IS NULL").select("path", F.col("_broken").alias("record"), reason.alias("reason")))


def read_trains(spark: SparkSession, path: str, fields: str, form: str | None = None) -> Documents:
    """(path, train_number, fields...), a row for each stop of the trains at path, and what could not be read; see read_documents."""
    got = read_documents(spark, path, f"train_number string, stop_times array<struct<{fields}>>", "train_instances", form)
    return Documents(got.rows.select("path", "train_number", F.inline("stop_times")), got.rejected)


def optional(spark: SparkSession, path: str, fields: str, root: str | None = None) -> DataFrame:
    """The records of the documents at path, or no rows of those fields where there is nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return read_documents(spark, path, fields, root).rows.drop("path") if there else spark.createDataFrame([], fields)


def write_layers(features: DataFrame, path: str) -> DataFrame:
    """Write (layer, id, feature) as text, a feature a line, a folder for each layer; returns the manifest (layer, features, geometry_type)."""
    features.select("layer", "feature").write.partitionBy("layer").text(path)
    kind = F.get_json_object(F.min_by("feature", "id"), "$.geometry.type")
    return features.groupBy("layer").agg(F.count("*").alias("features"), kind.alias("geometry_type"))


def collection(features: DataFrame) -> DataFrame:
    """(layer, document): one FeatureCollection for each layer, for layers that fit in a row."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda x: x["feature"]), ",")
    return features.groupBy("layer").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("document"))


def write_tiles(tiles: DataFrame, path: str, most: int = 20000) -> DataFrame:
    """Write (layer, z, x, y, feature) in a folder for each tile; returns the manifest of what is there, (layer, z, tiles, features).

    A tile of more than `most` features is dealt to several tasks, which write files of their own.
    """
    place = ["layer", "z", "x", "y"]
    counts = tiles.groupBy(*place).agg(F.ceil(F.count("*") / most).alias("pieces"))
    dealt = tiles.join(counts, place).withColumn("piece", F.pmod(F.xxhash64("feature"), F.col("pieces")))
    dealt.repartition(*place, "piece").select(*place, "feature").write.partitionBy(*place).text(path)
    found = tiles.sparkSession.read.text(path)
    return found.groupBy(*place).count().groupBy("layer", "z").agg(F.count("*").alias("tiles"), F.sum("count").alias("features"))


def write_whole(trains: DataFrame, path: str, block: str, cut=None) -> None:
    """One indented document for each value of `block`, a file of its own with its trains under train_instances; where `cut` is true the document stops in the middle, as a broken transfer would."""
    one = trains.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("train_number", "stop_times"))).alias("train_instances"))
    text = F.col("x") if cut is None else F.when(cut, F.expr("substring(x, 1, length(x) div 2)")).otherwise(F.col("x"))
    whole = one.withColumn("x", F.to_json(F.struct("train_instances"), {"pretty": "true"})).select(block, text.alias("text"))
    whole.repartition(block).write.partitionBy(block).text(path)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
