"""Timetable pages in the three page forms, rendered from visits, so that the parsers have whole pages to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrail.functions import clock

#: Trains on one detail page.
TRAINS = 3
#: Trips in one stretch of a part of a station's page.
STRETCH = 20000
SERVICES = ("のぞみ", "ひかり", "Komachi")


def _time(minute: Column) -> Column:
    return clock(F.pmod(minute, F.lit(1440)))


def _rows(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, body): the rows of each page put together in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda x: x["row"])
    return cells.groupBy(*keys).agg(F.array_join(rows, "\n").alias("body"))


def _column_name(trip: Column) -> Column:
    return F.when(trip % 4 == 0, "").otherwise(F.concat(F.element_at(F.array(*map(F.lit, SERVICES)), (trip % 3 + 1).cast("int")), F.lit(" "), trip.cast("string")))


def detail_pages(visits: DataFrame) -> DataFrame:
    """(page, url, html): three trains to a page, a column each, a row for each position; every fifth event passes through."""
    times = F.concat(_time(F.col("minute")), F.lit(' <span class="dep_arr">Arr.</span><br/>'), _time(F.col("dep")), F.lit('<span class="dep_arr">Dep.</span>'))
    cell = F.concat(F.lit('<td class="time">'), F.when(F.col("event_id") % 5 == 0, "レ").otherwise(times), F.lit('</td>\n<td class="platform"><b>'), (F.col("event_id") % 9).cast("string"), F.lit("</b></td>"))
    blank = '<td class="time"></td><td class="platform"></td>'
    placed = visits.select(F.floor(F.col("trip_id") / TRAINS).alias("page"), (F.col("trip_id") % TRAINS).alias("column"), "seq", cell.alias("cell"))
    columns = F.concat(*(F.coalesce(F.max(F.when(F.col("column") == k, F.col("cell"))), F.lit(blank)) for k in range(TRAINS)))
    rows = placed.groupBy("page", "seq").agg(columns.alias("cells")).withColumn("row", F.concat(F.lit('<tr class="time"><th class="time">Stop &amp; <i>no.</i> '), F.col("seq").cast("string"), F.lit("</th>"), "cells", F.lit("</tr>")))
    trains = visits.select("trip_id").distinct().withColumn("page", F.floor(F.col("trip_id") / TRAINS))
    head = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trip_id", c.alias("v")))), lambda x: F.concat(F.lit('<td align="center" colspan="2">'), x["v"], F.lit("</td>"))), "")
    number, name, kind = F.concat(F.lit("T"), F.col("trip_id").cast("string")), _column_name(F.col("trip_id")), F.when(F.col("trip_id") % 5 == 0, "").otherwise("Super&nbsp;Express")
    heads = trains.groupBy("page").agg(head(number).alias("numbers"), head(name).alias("names"), head(kind).alias("kinds"))
    page = F.concat(F.lit("<html><p>based on Mar. 2024 issue</p><h2>Yamanote Line for X (Clockwise)</h2><table id=\"tbl_train\" border=\"1\"><tr><th>Train number</th>"), "numbers", F.lit("</tr><tr><th>Train name</th>"), "names", F.lit("</tr><tr><th>Train type</th>"), "kinds", F.lit("</tr>"), "body", F.lit("</table></html>"))
    return _rows(rows, "page").join(heads, "page").select("page", F.concat(F.lit("https://example.org/train/"), F.col("page").cast("string")).alias("url"), page.alias("html"))


def two_column_pages(visits: DataFrame) -> DataFrame:
    """(trip_id, line, html): a page for each train, its times in the second of two columns, another train's in the first."""
    line = F.element_at(F.array(F.lit("main"), F.lit("west"), F.lit("other")), (F.col("trip_id") % 3 + 1).cast("int"))
    arrow = lambda c, sign: F.concat(_time(c), F.lit(sign))
    second = F.when(F.col("event_id") % 5 == 0, "レ").otherwise(F.concat(arrow(F.col("minute"), "着"), F.lit("<br>"), arrow(F.col("dep"), " 発")))
    row = F.concat(F.lit("<tr>\n<!-- 駅名 --><td>駅"), F.col("seq").cast("string"), F.lit("</td><td>"), arrow(F.col("minute") + 1, "発"), F.lit("</td><td></td><td>"), second, F.lit("</td><td>"), (F.col("event_id") % 9).cast("string"), F.lit("</td></tr>"))
    kinds = F.when(F.col("trip_id") % 3 == 0, "<td>特急</td><td>新幹線</td>").otherwise("<td>特急</td><td>特急</td>")
    names = F.concat(F.lit("<td>リレーかもめ"), F.col("trip_id").cast("string"), F.lit("号</td><td>かもめ"), (F.col("trip_id") + 1).cast("string"), F.lit("号</td>"))
    body = _rows(visits.select("trip_id", "seq", row.alias("row")), "trip_id")
    page = F.concat(F.lit("<table><tr><!-- 列車種 --><td>列車種</td>"), kinds, F.lit("</tr><tr class=x><!-- 列車名 --><td>列車名</td>"), names, F.lit("</tr>"), "body", F.lit("<tr><td>運転日</td><td colspan=\"2\">毎日 &amp; 祝日</td></tr></table>"))
    return body.select("trip_id", line.alias("line"), page.alias("html"))


def departure_grids(visits: DataFrame) -> DataFrame:
    """(station_id, day, direction, html): departures of a station on a day by hour."""
    minute = F.pmod(F.col("dep"), F.lit(1440))
    block = F.concat(F.lit("<TD nowrap class=S>"), F.element_at(F.array(F.lit("のぞみ"), F.lit("ひかり"), F.lit("こだま")), (F.col("trip_id") % 3 + 1).cast("int")), F.col("trip_id").cast("string"), F.lit("号<TR><TD nowrap class=MB><B>"), (minute % 60).cast("string"), F.lit("</B>◆<TR><TD nowrap class=S>行"), (F.col("event_id") % 7).cast("string"), F.lit("<TR>"))
    cells = visits.select("station_id", F.floor(F.col("dep") / 1440).alias("day"), F.when(F.col("event_id") % 2 == 0, "outbound").otherwise("inbound").alias("direction"), F.floor(minute / 60).cast("int").alias("hour"), "event_id", block.alias("block"))
    hours = cells.groupBy("station_id", "day", "direction", "hour").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "block"))), lambda x: x["block"]), "").alias("blocks"))
    rows = hours.withColumn("row", F.concat(F.lit("<FONT size=4><B>"), F.col("hour").cast("string"), F.lit("</B></FONT>"), "blocks")).withColumnRenamed("hour", "seq")
    return _rows(rows, "station_id", "day", "direction").select("station_id", "day", "direction", F.concat(F.lit("<FONT size=4>駅</FONT>"), "body").alias("html"))


def service_pages(visits: DataFrame) -> DataFrame:
    """(page, part, url, html): a page for each station, a marked cell for each visit, with the service's name and the train's link.

    Stations have any number of visits, so a page comes in parts: by the visits' numbers and then by stretches of trips.
    """
    service = F.element_at(F.array(*map(F.lit, ("みずほ", "さくら", "つばめ", "かもめ", "ひかり"))), (F.col("trip_id") % 5 + 1).cast("int"))
    link = F.concat(F.lit("/jr-k_time/2403/0101/"), F.col("trip_id").cast("string"), F.lit(".html?c="), F.col("station_id").cast("string"), F.lit("&ym=2403&d="), (F.col("seq") % 2).cast("string"))
    row = F.concat(F.lit('<tr><td class=time>'), _time(F.col("dep")), F.lit('</td><td class=back5a><b>'), service, F.lit('</b><a href="'), link, F.lit('">detail</a></td></tr>'))
    part = F.col("seq") * 2**32 + F.floor(F.col("trip_id") / STRETCH)
    cells = visits.select(F.col("station_id").alias("page"), part.alias("part"), F.col("trip_id").alias("seq"), row.alias("row"))
    return _rows(cells, "page", "part").select("page", "part", F.concat(F.lit("https://example.org/stations/"), F.col("page").cast("string")).alias("url"), F.concat(F.lit("<table>"), "body", F.lit("</table>")).alias("html"))
