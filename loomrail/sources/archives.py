"""Mirrored pages: archives of saved pages as a data source, one partition for each archive, in the charset they declare."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from loomrail.sources.adapters import read
from loomrail.sources.storage import new_folder

#: Where a page declares its charset, within its first bytes.
DECLARED, HEAD = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I), 2048
ADDRESS = "url"


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def decoded(page: bytes, charset: str | None) -> tuple[str | None, str | None, str | None]:
    """(charset, text, error) of a page: the given charset, else the declared one, else UTF-8; text is null where the bytes don't fit."""
    told = DECLARED.search(page[:HEAD])
    name = charset or (told.group(1).decode("ascii") if told else "utf-8")
    try:
        return name.lower(), page.decode(name), None
    except LookupError:
        return name.lower(), None, "unknown charset"
    except UnicodeDecodeError:
        return name.lower(), None, "bytes of another charset"


class ArchiveReader(DataSourceReader):
    """Reads zip archives whose entries are pages under their addresses; filters on url choose entries before anything is unpacked."""

    def __init__(self, path: str, charset: str | None) -> None:
        self.path, self.charset = path, charset
        self.equal: list[frozenset] = []
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (ADDRESS,):
                self.equal.append(frozenset([f.value]))
            elif isinstance(f, In) and f.attribute == (ADDRESS,):
                self.equal.append(frozenset(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == (ADDRESS,):
                self.starts.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in sorted(glob.glob(os.path.join(self.path, "*.zip")))] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.path:
            return
        name = os.path.basename(partition.path)
        try:
            with zipfile.ZipFile(partition.path) as held:
                for entry in held.infolist():
                    if all(entry.filename in e for e in self.equal) and all(entry.filename.startswith(s) for s in self.starts):
                        yield (name, entry.filename, *decoded(held.read(entry), self.charset))
        except zipfile.BadZipFile:
            yield name, None, None, None, "broken archive"


class MirroredPages(DataSource):
    """Option path: a folder that all executors see; option charset: of all pages, where their own word isn't to be trusted.

    Rows are (archive, url, charset, text, error). A page that can't be decoded has no text but an
    error, and a broken archive is one row with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "mirrored_pages"

    def schema(self) -> str:
        return "archive string, url string, charset string, text string, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"].removeprefix("file:"), self.options.get("charset"))


def mirrored(spark: SparkSession, path: str, charset: str | None = None) -> DataFrame:
    """The pages of all archives at path. Filters on url are handed to the source."""
    spark.dataSource.register(MirroredPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(MirroredPages.name()).option("path", path)
    return (reader.option("charset", charset) if charset else reader).load()


def write_archives(pages: DataFrame, path: str, charset: str, archives: int) -> DataFrame:
    """Save (url, html) in so many archives by a hash of the address, in the charset, which each page is told to declare; returns (archive, pages).

    Characters that the charset lacks become references. path must be a folder that all executors see;
    a task that is run again writes the same archive again, and only whole ones get their name.
    """
    folder = path.removeprefix("file:")

    def save(key, group):
        os.makedirs(folder, exist_ok=True)
        name = f"{key[0].as_py():06d}.zip"
        own = os.path.join(folder, f".{name}.{os.getpid()}")
        with zipfile.ZipFile(own, "w", zipfile.ZIP_DEFLATED) as out:
            for url, html in sorted(zip(group["url"].to_pylist(), group["html"].to_pylist())):
                text = f'<meta charset="{charset}">' + (html or "")
                out.writestr(zipfile.ZipInfo(url), text.encode(charset, "xmlcharrefreplace"))
        os.replace(own, os.path.join(folder, name))
        return pa.table({"archive": [name], "pages": pa.array([group.num_rows], pa.int64())})

    dealt = pages.select("url", "html", F.pmod(F.xxhash64("url"), F.lit(archives)).cast("int").alias("k"))
    return dealt.groupBy("k").applyInArrow(save, "archive string, pages bigint")


#: Pages in one archive, about.
ARCHIVE = 200


def _mirror(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "mirror")
    pages = read(spark, sf_dir, "pages").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")
    write_archives(pages, path, "euc-jp", pages.count() // ARCHIVE + 1).write.format("noop").mode("overwrite").save()
    return path


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page out of a mirror in EUC-JP, with a digest of all but what that charset had no sign for."""
    rows = mirrored(spark, _mirror(spark, sf_dir))
    page = F.regexp_replace("text", "^<meta[^>]*>", "")
    return rows.select(F.substring_index("url", "#", -1).cast("long").alias("page_id"), F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "charset", F.md5(F.regexp_replace(page, r"[^\x00-\x7f]|&#[0-9]+;", "").cast("binary")).alias("digest"), "error")


def _of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one scheme, chosen before their archives are unpacked, by host."""
    rows = mirrored(spark, _mirror(spark, sf_dir)).where(F.col("url").startswith("https://"))
    return rows.groupBy(F.regexp_extract("url", "^https://([^/#]*)", 1).alias("host")).agg(F.count("*").alias("pages"))


QUERIES = {"mirror_roundtrip": _roundtrip, "mirror_hosts": _of_host}
ORACLE = {
    "mirror_roundtrip": r"SELECT page_id, url, 'euc-jp' AS charset, md5(regexp_replace(html, '[^\x00-\x7f]|&#[0-9]+;', '', 'g')) AS digest, NULL::VARCHAR AS error FROM pages",
    "mirror_hosts": "SELECT regexp_extract(url, '^https://([^/#]*)', 1) AS host, count(*) AS pages FROM pages WHERE url LIKE 'https://%' GROUP BY 1",
}
