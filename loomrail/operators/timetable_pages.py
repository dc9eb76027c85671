"""Parsers of timetable pages: columns of trains, rows of times, departure grids, and links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.functions import absolute_link, plain_text, romanised, service_parts, stripped, unescaped
from loomrail.sources.adapters import SQL, read, stop_times
from loomrail.sources.rendered_pages import departure_grids, detail_pages, service_pages, two_column_pages
from loomrail.sources.storage import ranked

def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a group, and an empty list where text is null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def anchors(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, pos, href, text, link) of each anchor with an address, wherever href stands among its attributes; text without tags inside."""
    tags = found(F.col(html_col), r"(?is)<a\s[^>]*>.*?</a\s*>", 0)
    every = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.posexplode(tags).alias("pos", "tag"))
    opening = F.regexp_extract("tag", r"(?is)^(<a\s[^>]*>)", 1)
    href = F.regexp_extract(opening, r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s>"']+)""", 1)
    single = F.regexp_extract(opening, r"""(?is)\shref\s*=\s*'([^']*)'""", 1)
    bare = F.regexp_extract(opening, r"""(?is)\shref\s*=\s*([^\s>"']+)""", 1)
    got = every.where(opening.rlike(r"(?is)\shref\s*=")).withColumn("href", unescaped(F.coalesce(F.nullif(href, F.lit("")), F.nullif(single, F.lit("")), bare)))
    return got.select("page_id", F.col("pos").cast("long").alias("pos"), "href", plain_text(F.col("tag")).alias("text"), absolute_link(F.col("url"), F.col("href")).alias("link"))


def timetable_links(links: DataFrame, keyword: str | None = None) -> DataFrame:
    """Links whose text or address speaks of a timetable or a list, and of the keyword."""
    words = F.lower(F.concat_ws(" ", "text", "href"))
    keep = F.contains(words, F.lit("/timetable/")) | F.contains(words, F.lit("list"))
    return links.where(keep & (F.contains(words, F.lit(keyword.lower())) if keyword else F.lit(True)))


def train_links(links: DataFrame) -> DataFrame:
    """Links to trains, each address once at its first place on any page."""
    firsts = links.where(F.contains("href", F.lit("/train/"))).groupBy("link").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    return firsts.select("link", F.col("at.page_id").alias("page_id"), F.col("at.pos").alias("pos"))


#: A comment, a tag or a stretch of text.
TOKEN = "(?s)<!--.*?-->|<[^>]*>|[^<]+"


def tokens(pages: DataFrame, *keys: str, html_col: str = "html") -> DataFrame:
    """(keys, pos, tag, token, text, before, before_that): each tag, comment and stretch of text of a page in order.

    tag is the lower-case name, with / for closing tags, "!" for comments, and empty for text; before and
    before_that are the one and two tokens before it.
    """
    every = pages.select(*keys, F.posexplode(found(F.col(html_col), TOKEN, 0)).alias("pos", "token"))
    tag = F.when(F.startswith("token", F.lit("<!")), "!").otherwise(F.lower(F.regexp_extract("token", "^<(/?[A-Za-z][A-Za-z0-9]*)", 1)))
    order = Window.partitionBy(*keys).orderBy("pos")
    read = every.withColumns({"tag": tag, "text": F.when(tag == "", F.col("token")), "before": F.lag("token").over(order), "before_that": F.lag("token", 2).over(order)})
    return read


def attribute(tag: Column, name: str) -> Column:
    """An attribute of an opening tag, null without it."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""", 1)
    return F.when(tag.rlike(rf"(?is)\s{name}\s*="), F.regexp_replace(value, "^[\"']|[\"']$", ""))


CELLS = "array<struct<cell: long, place: int, table_id: string, label: string, tag: string, class: string, colspan: string, pieces: array<struct<text: string, tag: string>>, text: string>>"
#: Rows of tables in one batch that a task gives back.
ROWS = 1 << 12


def _rows_of(page: str) -> Iterator[tuple]:
    """(row, row_class, cells) of each row of a page that has cells, in one walk over its tokens."""
    flags = re.IGNORECASE | re.ASCII
    value = {n: re.compile(rf"""\s{n}\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""", flags) for n in ("id", "class", "colspan")}
    attribute = lambda tag, name: re.sub("^[\"']|[\"']$", "", found[1]) if (found := value[name].search(tag)) else None
    name = re.compile("<(/?[A-Za-z][A-Za-z0-9]*)")
    spaces, inner = re.compile(r"\s+"), re.compile("<[^>]+>")

    def with_text(cell: tuple) -> tuple:
        text = " ".join(t for t, _ in cell[-1])
        text = html.unescape(inner.sub(" ", text) if "<" in text else text)
        return *cell, spaces.sub(" ", text).strip(" ")

    row = number = 0
    row_class = table_id = label = before = pieces = None
    cells: list[tuple] = []
    for token in re.findall(TOKEN, page):
        match = name.match(token)
        tag = "!" if token.startswith("<!") else match[1].lower() if match else ""
        if not tag and pieces is not None:
            pieces.append((token, before))
        elif tag in ("table", "/table"):
            table_id, pieces = attribute(token, "id") if tag == "table" else None, None
        elif tag == "!":
            label = re.sub("^<!-*|-*>$", "", token).strip(" ")
        elif tag in ("tr", "/tr"):
            label = pieces = None
            if tag == "tr":
                if cells:
                    yield row, row_class, [*map(with_text, cells)]
                row, row_class, cells = row + 1, attribute(token, "class"), []
        elif tag in ("td", "th"):
            number, pieces = number + 1, []
            if row:
                cells.append((number, len(cells), table_id, label, tag, attribute(token, "class"), attribute(token, "colspan"), pieces))
            else:
                pieces = None
        elif tag in ("/td", "/th"):
            pieces = None
        before = token
    if cells:
        yield row, row_class, [*map(with_text, cells)]


def table_rows(pages: DataFrame, *keys: str, html_col: str = "html") -> DataFrame:
    """(keys, row, row_class, cells) of each row with cells of each table; cells: (cell, place, table_id, label, tag, class, colspan, pieces, text).

    row and cell count over the page; place counts within the row, from 0. label is the text of a comment
    before a row's first cell. pieces are the stretches of text with the tag right before each; text is
    all of them as in plain_text. A cell ends where it is closed or the next cell or row begins. A page is
    walked through once where it is; its tokens are never dealt out or sorted.
    """
    given = pages.select(*keys, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)
    kind = pa.list_(pa.struct([("cell", pa.int64()), ("place", pa.int32()), *((n, pa.string()) for n in ("table_id", "label", "tag", "class", "colspan")), ("pieces", pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string())]))), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, got = [], []
            for i in range(b.num_rows):
                for x in _rows_of(b["_html"][i].as_py() or ""):
                    at.append(i)
                    got.append(x)
                    if len(got) == ROWS:
                        yield batch(b, at, got)
                        at, got = [], []
            if got:
                yield batch(b, at, got)

    def batch(b: pa.RecordBatch, at: list[int], got: list[tuple]) -> pa.RecordBatch:
        row, row_class, cells = zip(*got)
        return pa.RecordBatch.from_arrays([*(b[k].take(pa.array(at)) for k in keys), pa.array(row, pa.int64()), pa.array(row_class, pa.string()), pa.array(cells, kind)], [*keys, "row", "row_class", "cells"])

    return given.mapInArrow(run, f"{schema}, row long, row_class string, cells {CELLS}")


# Labels, names and signs of the pages that are read.
DETAIL_TABLE, NUMBER, NAME, TYPE, TIME, PLATFORM, SIGN = "tbl_train", "Train number", "Train name", "Train type", "time", "platform", "dep_arr"
ARRIVES, DEPARTS = "Arr.", "Dep."
LINE_TITLE, DIRECTIONS, ISSUE = "Yamanote Line for ", ("Clockwise", "Counterclockwise"), ("based on ", " issue")
STATION, KINDS, NAMES, DAYS, PASSES, COMES, GOES = "駅名", "列車種", "列車名", "運転日", "レ", "着", "発"
MAIN_TYPE, MAIN_NAME, RELAY = "新幹線", "かもめ", "リレー"
#: Lines whose column goes by the type, and by the name where no type tells.
BY_TYPE, BY_NAME = ("west", "main"), ("west",)
SERVICE_CELL, SERVICE_LINK = "back5", "/jr-k_time/"
LINE_SERVICES = {"main": ["みずほ", "さくら", "つばめ"], "west": ["かもめ"]}


def _blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _titled(rows: DataFrame) -> DataFrame:
    """rows with title, which of the three heads a row is (null for others), and wide, the texts of its wide cells in order."""
    heads = F.filter("cells", lambda c: c["table_id"] == DETAIL_TABLE)
    title = F.get(F.filter(heads, lambda c: (c["tag"] == "th") & c["text"].isin(NUMBER, NAME, TYPE)), F.lit(0))["text"]
    wide = F.transform(F.filter(heads, lambda c: (c["tag"] == "td") & (c["colspan"] == "2")), lambda c: c["text"])
    return rows.withColumns({"title": title, "wide": wide})


def detail_trains(pages: DataFrame) -> DataFrame:
    """(page, position, train_number, train_type, name, service, number, direction, issue) of each column of each page; pages without the table are left out."""
    texts = lambda test: F.get(F.filter(found(F.col("html"), TOKEN, 0), lambda t: test(t) & (F.startswith(t, F.lit("<!")) | (F.regexp_extract(t, "^<(/?[A-Za-z][A-Za-z0-9]*)", 1) != "")).__invert__()), F.lit(0))
    way = lambda t: F.coalesce(*(F.when(F.contains(t, F.lit(f"({d})")), d.lower()) for d in DIRECTIONS))
    titled = texts(lambda t: F.startswith(F.trim(t), F.lit(LINE_TITLE)) & way(t).isNotNull())
    dated = texts(lambda t: F.contains(t, F.lit(ISSUE[0])) & F.contains(t, F.lit(ISSUE[1])))
    month = F.substring_index(F.substring_index("dated", ISSUE[0], -1), ISSUE[1], 1)
    facts = pages.select("page", "html", titled.alias("titled"), dated.alias("dated")).select("page", "html", way(F.col("titled")).alias("direction"), month.alias("issue"))
    keys = ["page", "direction", "issue"]
    wide = _titled(table_rows(facts, *keys)).where("title IS NOT NULL").select(*keys, "row", "title", F.posexplode("wide").alias("position", "text"))
    rows = wide.groupBy(*keys, "position").agg(*(F.min_by("text", F.when(F.col("title") == n, F.col("row"))).alias(n) for n in (NUMBER, NAME, TYPE))).where(F.col(NUMBER).isNotNull()).withColumn("name", _blank(F.col(NAME)))
    service, number = service_parts(F.col("name"))
    return rows.select("page", F.col("position").cast("int"), F.col(NUMBER).alias("train_number"), _blank(F.col(TYPE)).alias("train_type"), "name", service.alias("service"), number.alias("number"), "direction", "issue")


def detail_stops(pages: DataFrame) -> DataFrame:
    """(page, train_number, sequence, station, arrival, departure, platform): sequence is the row's number, so rows without a time leave gaps."""
    rows = _titled(table_rows(pages, "page"))
    timed = F.when(F.col("row_class") == TIME, F.filter("cells", lambda c: c["table_id"] == DETAIL_TABLE))
    rows = rows.select("page", "row", "title", "wide", F.when(F.size(timed) > 0, timed).alias("timed")).where("title IS NOT NULL OR timed IS NOT NULL")
    # a time ends the piece before its sign; the last of a kind counts
    piece = lambda c, i: F.get(c["pieces"], i)
    signs = lambda c: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c["pieces"]), F.lit(1))), lambda i: F.struct(F.trim(piece(c, i)["text"]).alias("sign"), piece(c, i)["tag"].alias("tag"), F.regexp_extract(F.coalesce(piece(c, i - 1)["text"], F.lit("")), "([0-9]{2}:[0-9]{2})\\s*$", 1).alias("time"))), lambda x: (x["time"] != "") & (attribute(x["tag"], "class") == SIGN))
    station = lambda i: F.get(F.filter(F.slice("timed", F.lit(1), i + 1), lambda c: (c["tag"] == "th") & (c["class"] == TIME)), F.lit(0))["text"]
    pair = lambda i: F.struct(F.coalesce(station(i), F.lit("")).alias("station"), signs(F.get("timed", i)).alias("signs"), _blank(F.get("timed", i + 1)["text"]).alias("platform"))
    begins = lambda i: (F.get("timed", i)["tag"] == "td") & (F.get("timed", i)["class"] == TIME) & (F.get("timed", i + 1)["class"] == PLATFORM)
    pairs = F.when(F.col("timed").isNotNull(), F.transform(F.filter(F.sequence(F.lit(0), F.size("timed") - 1), begins), pair))
    rows = rows.select("page", "row", F.when(F.col("title") == NUMBER, F.col("wide")).alias("wide"), pairs.alias("pairs"))
    page = Window.partitionBy("page")
    numbers = F.array_sort(F.collect_list(F.when(F.col("wide").isNotNull(), F.struct("row", "wide"))).over(page))
    rows = rows.withColumns({"numbers": numbers, "sequence": F.sum(F.when(F.col("pairs").isNotNull(), 1).otherwise(0)).over(page.orderBy("row"))})
    each = rows.select("page", "numbers", "sequence", F.posexplode("pairs").alias("position", "p"))
    number = F.get(F.filter(F.transform("numbers", lambda x: F.get(x["wide"], F.col("position"))), lambda x: x.isNotNull()), F.lit(0))
    last = lambda kind: F.try_element_at(F.filter("p.signs", lambda x: x["sign"] == kind), F.lit(-1))["time"]
    got = each.select("page", number.alias("train_number"), F.col("sequence").cast("long"), "p.station", last(ARRIVES).alias("arrival"), last(DEPARTS).alias("departure"), "p.platform")
    return got.where("train_number IS NOT NULL AND (arrival IS NOT NULL OR departure IS NOT NULL)")


def of_type(trains: DataFrame, wanted: str | None) -> DataFrame:
    """Trains whose type holds the wanted one; those without a type stay, and all where none is wanted."""
    kind = F.col("train_type")
    return trains.where(F.lit(not wanted) | F.coalesce(kind == "", F.lit(True)) | F.contains(kind, F.lit(wanted or "")))


def service_links(pages: DataFrame, services: list[str]) -> DataFrame:
    """(page, place, link): the first link of each marked cell that names one of the services, each address once on a page; all where no service is given.

    A long page may come in parts, a row each, in the order of a column part.
    """
    parts = pages if "part" in pages.columns else pages.withColumn("part", F.lit(0))
    marked = table_rows(parts, "page", "part", "url").select("page", "part", "url", F.inline(F.filter("cells", lambda c: (c["tag"] == "td") & F.startswith(c["class"], F.lit(SERVICE_CELL)))))
    links = F.filter(F.transform("pieces", lambda p: attribute(p["tag"], "href")), lambda h: F.startswith(h, F.lit(SERVICE_LINK)))
    named = F.lit(not services) | F.exists(F.array(*map(F.lit, services or [""])), lambda n: F.contains("text", n))
    got = marked.where(named).select("page", "part", "url", "cell", F.get(links, F.lit(0)).alias("href")).where("href IS NOT NULL")
    firsts = got.groupBy("page", "href").agg(F.min(F.struct("part", "cell", "url")).alias("at"))
    return firsts.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("at.part", "at.cell")) - 1).alias("place"), absolute_link(F.col("at.url"), unescaped(F.col("href"))).alias("link"))


def _of_column(rows: DataFrame) -> DataFrame:
    """rows of trips' pages with column, name and days: the column of the train that is wanted, and its values.

    On lines with a main service it is the first column of that type, on some else the first whose name
    has the service without a relay; elsewhere the first. A list shorter than the column gives its first
    value; a value that is not listed comes from the wide cell after its label.
    """
    page = Window.partitionBy("trip_id")
    listed = lambda n: F.transform(F.filter("cells", lambda c: (c["label"] == n) & (c["tag"] == "td") & (c["place"] > 0)), lambda c: c["text"])
    follows = lambda n: F.get(F.filter("cells", lambda c: (c["tag"] == "td") & (c["colspan"] == "2") & (F.get("cells", c["place"] - 1)["text"] == n)), F.lit(0))["text"]
    own = rows.withColumns({**{f"l_{n}": listed(n) for n in (KINDS, NAMES, DAYS)}, **{f"w_{n}": follows(n) for n in (NAMES, DAYS)}}).drop("cells")
    lists = {n: F.max_by(f"l_{n}", F.when(F.size(f"l_{n}") > 0, F.col("row"))).over(page) for n in (KINDS, NAMES, DAYS)}
    wide = {f"wide_{n}": F.min_by(f"w_{n}", F.when(F.col(f"w_{n}").isNotNull(), F.col("row"))).over(page) for n in (NAMES, DAYS)}
    at = lambda n, test: F.array_position(F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), test), True)
    by_type = F.when(F.col("line").isin(*BY_TYPE), at(KINDS, lambda v: F.contains(v, F.lit(MAIN_TYPE))))
    by_name = F.when(F.col("line").isin(*BY_NAME), at(NAMES, lambda v: F.contains(v, F.lit(MAIN_NAME)) & ~F.contains(v, F.lit(RELAY))))
    column = F.coalesce(F.nullif(by_type, F.lit(0)), F.nullif(by_name, F.lit(0)), F.lit(1)).cast("int") - 1
    known = own.withColumns({**lists, **wide}).withColumn("column", column)
    value = lambda n: F.coalesce(_blank(F.when(F.col("column") < F.size(n), F.get(n, F.col("column"))).otherwise(F.get(n, F.lit(0)))), F.col(f"wide_{n}"))
    return known.withColumns({"name": value(NAMES), "days": value(DAYS)})


def two_column_stops(pages: DataFrame) -> DataFrame:
    """(trip_id, position, name, service, number, sequence, arrival, departure, platform, days) of the chosen column; passed stations and rows without a time go."""
    texts = F.when(F.col("row_class").isNull(), F.transform(F.filter("cells", lambda c: (c["label"] == STATION) & (c["tag"] == "td")), lambda c: c["text"]))
    rows = table_rows(pages, "trip_id", "line").withColumn("texts", F.when(F.size(texts) > 0, texts))
    rows = _of_column(rows).withColumn("sequence", F.sum(F.when(F.col("texts").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("trip_id").orderBy("row")))
    # after the station's name, cells come in pairs of time and platform
    time, platform = F.get("texts", 2 * F.col("column") + 1), F.get("texts", 2 * F.col("column") + 2)
    got = rows.where((F.size("texts") > 2) & (2 * F.col("column") + 1 < F.size("texts"))).withColumns({"time": time, "platform": _blank(F.coalesce(platform, F.lit("")))}).where(~F.contains("time", F.lit(PASSES)))
    last = lambda sign: F.try_element_at(found(F.col("time"), f"([0-9]{{2}}:[0-9]{{2}})\\s*{sign}"), F.lit(-1))
    timed = got.withColumns({"arrival": last(COMES), "departure": last(GOES)}).where("arrival IS NOT NULL OR departure IS NOT NULL")
    service, number = service_parts(F.col("name"))
    return timed.select("trip_id", F.col("column").cast("long").alias("position"), "name", service.alias("service"), number.alias("number"), F.col("sequence").cast("long"), "arrival", "departure", "platform", "days")


def grid_departures(pages: DataFrame) -> DataFrame:
    """(station_id, day, direction, departure, service, number, destination) of every block under its hour; blocks without a numbered service go.

    A block is three small cells in a row: the train, the minute in bold, where it goes to.
    """
    keys = ["station_id", "day", "direction"]
    texts = tokens(pages, *keys)
    order = Window.partitionBy(*keys).orderBy("pos")
    digits, bold = stripped(F.col("text")).rlike("^[0-9]{1,2}$"), F.lower(F.col("before")) == "<b>"
    hour = digits & bold & (attribute(F.col("before_that"), "size") == "4")
    small = F.last(F.when(F.col("tag").isin("td", "tr"), F.struct(F.when(F.col("tag") == "td", attribute(F.col("token"), "class")).alias("v"))), True).over(order)["v"]
    marked = texts.withColumns({"class": small, "hour": F.last(F.when(hour, stripped(F.col("text")).cast("int")), True).over(order)}).where("text IS NOT NULL AND class IS NOT NULL")
    # a mark after the minute is no text of its own cell
    marked = marked.where((F.col("class") == "S") | (F.startswith("class", F.lit("M")) & digits & bold))
    around = {f"{name}_{c}": f(c).over(order) for name, f in (("last", F.lag), ("next", F.lead)) for c in ("class", "text", "hour")}
    blocks = marked.withColumns(around).where("class <> 'S' AND last_class = 'S' AND next_class = 'S' AND hour = last_hour AND hour = next_hour")
    train = stripped(F.col("last_text"))
    named = blocks.withColumns({"service": F.regexp_extract(train, "([\\p{IsHiragana}\\p{IsKatakana}\\p{IsHan}ー]+)[0-9]+号", 1), "number": F.regexp_extract(train, "[\\p{IsHiragana}\\p{IsKatakana}\\p{IsHan}ー]+([0-9]+)号", 1)}).where("service <> ''")
    departure = F.format_string("%02d:%02d", "hour", stripped(F.col("text")).cast("int"))
    return named.select(*keys, departure.alias("departure"), romanised(F.col("service")).alias("service"), F.col("number").cast("long").alias("number"), stripped(F.col("next_text")).alias("destination"))


def grid_trains(departures: DataFrame, covered: tuple = (0, 8)) -> DataFrame:
    """(train_id, label, stops, first_station, first_departure): trains of a day put together from departures at stations.

    At each station an outbound train has its earliest departure and an inbound one its latest; outbound
    trains visit stations in order, inbound ones the other way. Trains that begin at a covered station go,
    as other sources have them.
    """
    best = departures.groupBy("service", "number", "direction", "day", "station_id").agg(F.min("departure").alias("low"), F.max("departure").alias("high"))
    out = F.col("direction") == "outbound"
    stops = best.groupBy("service", "number", "direction", "day").agg(F.min_by(F.struct("station_id", "low"), "station_id").alias("a"), F.max_by(F.struct("station_id", "high"), "station_id").alias("b"), F.count("*").alias("stops"))
    begin = stops.withColumn("first_station", F.when(out, F.col("a.station_id")).otherwise(F.col("b.station_id"))).withColumn("first_departure", F.when(out, F.col("a.low")).otherwise(F.col("b.high")))
    train = F.concat_ws("_", F.lit("JRC"), F.upper("service"), F.col("number").cast("string"), F.upper("direction"))
    return begin.where(~F.col("first_station").isin(*covered)).select(train.alias("train_id"), "day", F.concat_ws(" ", "service", F.col("number").cast("string")).alias("label"), "stops", "first_station", "first_departure")


def supplement_order(trains: DataFrame) -> DataFrame:
    """(day, pos, train_id): the trains of each day by first departure, service, number and direction; ranges of days are numbered side by side."""
    parts = F.split("train_id", "_")
    rows = trains.select("day", "first_departure", F.substring_index("label", " ", 1).alias("service"), F.substring_index("label", " ", -1).cast("long").alias("number"), F.get(parts, F.size(parts) - 1).alias("way"), "train_id")
    every = ranked(rows, "day", "first_departure", "service", "number", "way", name="place")
    first = every.groupBy("day").agg(F.min("place").alias("first"))
    return every.join(first, "day").select("day", (F.col("place") - F.col("first") + 1).alias("pos"), "train_id")


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_times(read(spark, sf_dir, "events"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors(read(spark, sf_dir, "pages"))


def _sorted_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every page; those of every third page lie under /train/, of every fourth under /Timetable/, the others where they are."""
    k = F.col("page_id")
    path = F.concat(F.when(k % 3 == 0, "/train").when(k % 4 == 0, "/Timetable").otherwise(""), F.col("href"))
    return _anchors(spark, sf_dir).withColumn("href", path).withColumn("link", F.concat(F.lit("https://example.org"), "href"))


QUERIES = {
    "page_anchors": lambda spark, sf_dir: _anchors(spark, sf_dir),
    "page_train_links": lambda spark, sf_dir: train_links(_sorted_anchors(spark, sf_dir)),
    "page_timetable_links": lambda spark, sf_dir: timetable_links(_sorted_anchors(spark, sf_dir), "The").select("page_id", "pos"),
    "service_page_links": lambda spark, sf_dir: service_links(service_pages(_visits(spark, sf_dir)), LINE_SERVICES["main"]),
    "trains_of_type": lambda spark, sf_dir: of_type(detail_trains(detail_pages(_visits(spark, sf_dir))), "Local").select("page", "train_number", "train_type"),
    "supplement_order": lambda spark, sf_dir: supplement_order(grid_trains(grid_departures(departure_grids(_visits(spark, sf_dir))))),
    "detail_page_trains": lambda spark, sf_dir: detail_trains(detail_pages(_visits(spark, sf_dir))),
    "detail_page_stops": lambda spark, sf_dir: detail_stops(detail_pages(_visits(spark, sf_dir))),
    "two_column_page_stops": lambda spark, sf_dir: two_column_stops(two_column_pages(_visits(spark, sf_dir))),
    "grid_page_departures": lambda spark, sf_dir: grid_departures(departure_grids(_visits(spark, sf_dir))),
    "grid_page_trains": lambda spark, sf_dir: grid_trains(grid_departures(departure_grids(_visits(spark, sf_dir)))),
}

_HHMM = "lpad(CAST(({0}) % 1440 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0}) % 60 AS VARCHAR), 2, '0')"
_ANCHOR = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)))) AS pos FROM pages"
_GRID = f"SELECT station_id, dep // 1440 AS day, CASE WHEN event_id % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction, {_HHMM.format('dep')} AS departure, CASE trip_id % 3 WHEN 0 THEN 'Nozomi' WHEN 1 THEN 'Hikari' ELSE 'Kodama' END AS service, trip_id AS number, '行' || (event_id % 7) AS destination FROM {SQL['st']}"

#: What the parsers must find, out of the tables that the pages were made from.
ORACLE = {
    "page_anchors": f"SELECT page_id, pos, href, href[2:] AS text, regexp_extract(url, '^(https?://[^/]*)', 1) || href AS link FROM ({_ANCHOR})",
    "page_train_links": f"SELECT 'https://example.org/train' || href AS link, min(page_id) AS page_id, arg_min(pos, page_id * 100000000 + pos) AS pos FROM ({_ANCHOR}) WHERE page_id % 3 = 0 GROUP BY href",
    "page_timetable_links": f"SELECT page_id, pos FROM ({_ANCHOR}) WHERE contains(lower(href), 'the') AND ((page_id % 4 = 0 AND page_id % 3 <> 0) OR contains(lower(href), 'list'))",
    "service_page_links": f"""
SELECT page, row_number() OVER (PARTITION BY page ORDER BY first) - 1 AS place, link FROM (SELECT station_id AS page, min(seq * 1000000 + trip_id) AS first, 'https://example.org/jr-k_time/2403/0101/' || trip_id || '.html?c=' || station_id || '&ym=2403&d=' || (seq % 2) AS link
  FROM {SQL['st']} WHERE trip_id % 5 < 3 GROUP BY station_id, trip_id, seq % 2)""",
    "trains_of_type": f"SELECT DISTINCT trip_id // 3 AS page, 'T' || trip_id AS train_number, NULL::VARCHAR AS train_type FROM {SQL['st']} WHERE trip_id % 5 = 0",
    "supplement_order": f"""
WITH g AS ({_GRID}), b AS (SELECT service, number, direction, day, station_id, CASE WHEN direction = 'outbound' THEN min(departure) ELSE max(departure) END AS t FROM g GROUP BY service, number, direction, day, station_id),
f AS (SELECT *, row_number() OVER (PARTITION BY service, number, direction, day ORDER BY CASE WHEN direction = 'outbound' THEN station_id ELSE -station_id END) AS k FROM b)
SELECT day, row_number() OVER (PARTITION BY day ORDER BY t, service, number, upper(direction)) AS pos, 'JRC_' || upper(service) || '_' || number || '_' || upper(direction) AS train_id FROM f WHERE k = 1 AND station_id NOT IN (0, 8)""",
    "detail_page_trains": f"""
SELECT trip_id // 3 AS page, row_number() OVER (PARTITION BY trip_id // 3 ORDER BY trip_id) - 1 AS position, 'T' || trip_id AS train_number, CASE WHEN trip_id % 5 > 0 THEN 'Super Express' END AS train_type,
       CASE WHEN trip_id % 4 > 0 THEN CASE trip_id % 3 WHEN 0 THEN 'のぞみ' WHEN 1 THEN 'ひかり' ELSE 'Komachi' END || ' ' || trip_id END AS name,
       CASE WHEN trip_id % 4 > 0 THEN CASE trip_id % 3 WHEN 0 THEN 'Nozomi' WHEN 1 THEN 'Hikari' ELSE 'Komachi' END END AS service,
       CASE WHEN trip_id % 4 > 0 THEN CAST(trip_id AS VARCHAR) END AS number, 'clockwise' AS direction, 'Mar. 2024' AS issue FROM (SELECT DISTINCT trip_id FROM {SQL['st']})""",
    "detail_page_stops": f"""
SELECT trip_id // 3 AS page, 'T' || trip_id AS train_number, seq AS sequence, 'Stop & no. ' || seq AS station, {_HHMM.format('minute')} AS arrival, {_HHMM.format('dep')} AS departure, CAST(event_id % 9 AS VARCHAR) AS platform FROM {SQL['st']} WHERE event_id % 5 <> 0""",
    "two_column_page_stops": f"""
SELECT trip_id, CASE WHEN trip_id % 3 < 2 THEN 1 ELSE 0 END AS position, CASE WHEN trip_id % 3 < 2 THEN 'かもめ' || (trip_id + 1) || '号' ELSE 'リレーかもめ' || trip_id || '号' END AS name,
       CASE WHEN trip_id % 3 < 2 THEN 'Kamome' ELSE 'リレーかもめ' END AS service, CAST(trip_id + (trip_id % 3 < 2)::INT AS VARCHAR) AS number, seq AS sequence,
       CASE WHEN trip_id % 3 < 2 THEN {_HHMM.format('minute')} END AS arrival, CASE WHEN trip_id % 3 < 2 THEN {_HHMM.format('dep')} ELSE {_HHMM.format('minute + 1')} END AS departure,
       CASE WHEN trip_id % 3 < 2 THEN CAST(event_id % 9 AS VARCHAR) END AS platform, '毎日 & 祝日' AS days FROM {SQL['st']} WHERE trip_id % 3 = 2 OR event_id % 5 <> 0""",
    "grid_page_departures": _GRID,
    "grid_page_trains": f"""
WITH g AS ({_GRID}), b AS (SELECT service, number, direction, day, station_id, CASE WHEN direction = 'outbound' THEN min(departure) ELSE max(departure) END AS t FROM g GROUP BY service, number, direction, day, station_id),
f AS (SELECT *, row_number() OVER (PARTITION BY service, number, direction, day ORDER BY CASE WHEN direction = 'outbound' THEN station_id ELSE -station_id END) AS k, count(*) OVER (PARTITION BY service, number, direction, day) AS stops FROM b)
SELECT 'JRC_' || upper(service) || '_' || number || '_' || upper(direction) AS train_id, day, service || ' ' || number AS label, stops, station_id AS first_station, t AS first_departure FROM f WHERE k = 1 AND station_id NOT IN (0, 8)""",
}
