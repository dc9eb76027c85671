"""Page parsers on pages made by hand."""

from pyspark.sql import functions as F

from loomrail.functions import normal_name, plain_text
from loomrail.operators import timetable_pages as pages
from loomrail.sources.rendered_pages import service_pages

DETAIL = """<html><head><!-- <table id="tbl_train"> --></head><body>
<h2>Yamanote Line for Shibuya and Shinjuku (Counterclockwise)</h2><p>This is based on Sep. 2023 issue of it.</p>
<table id="other"><tr class="time"><th class="time">No</th><td class="time">01:01 <span class="dep_arr">Dep.</span></td><td class="platform">9</td></tr></table>
<table id="tbl_train" border="1">
<tr><th>Train number</th><td align="center" colspan="2">301G</td><td colspan="2" class='x'>1203A</td></tr>
<tr><th>Train name</th><td colspan="2"></td><td colspan="2">Hikari&nbsp;<b>501</b></td></tr>
<tr><th>Train type</th><td colspan="2">Local</td></tr>
<tr class="time"><th class="time">Tōkyō &amp; East</th><td class="time">04:30 <span class="dep_arr">Dep.</span></td><td class="platform"><b>4</b></td>
    <td class="time"></td><td class="platform"></td></tr>
<tr class="time"><th class="time">Passed</th><td class="time">レ</td><td class="platform"></td><td class="time">||</td><td class="platform">-</td></tr>
<tr class="note"><th class="time">Note</th><td class="time">05:00 <span class="dep_arr">Dep.</span></td><td class="platform">1</td></tr>
<tr class="time"><th class="time">Kanda</th><td class="time">04:32<span class="dep_arr">Arr.</span><br/>04:33 <span class="dep_arr">Dep.</span></td><td class="platform">2</td>
    <td class="time">25:10 <span class="dep_arr">Arr.</span> 25:12 <span class="x">Dep.</span></td><td class="platform">5</td>
    <td class="time">09:09 <span class="dep_arr">Dep.</span></td><td class="platform">7</td></tr>
</table></body></html>"""


def test_detail_page(spark):
    rows = spark.createDataFrame([(1, DETAIL), (2, None), (3, "<p>no table</p>")], "page long, html string")
    trains = [tuple(r) for r in pages.detail_trains(rows).orderBy("position").collect()]
    assert trains == [(1, 0, "301G", "Local", None, None, None, "counterclockwise", "Sep. 2023"), (1, 1, "1203A", None, "Hikari 501", "Hikari", "501", "counterclockwise", "Sep. 2023")]
    stops = sorted(tuple(r)[1:] for r in pages.detail_stops(rows).collect())
    assert stops == [("1203A", 3, "Kanda", "25:10", None, "5"), ("301G", 1, "Tōkyō & East", None, "04:30", "4"), ("301G", 3, "Kanda", "04:32", "04:33", "2")]
    kept = lambda wanted: sorted(r["train_number"] for r in pages.of_type(pages.detail_trains(rows), wanted).collect())
    assert kept("Loc") == kept(None) == kept("") == ["1203A", "301G"] and kept("Rapid") == ["1203A"]


def two(kinds, names, days="<td>運転日</td><td colspan=\"2\">毎日<br>&amp; 祝日</td>"):
    cells = lambda xs: "".join(f"<td>{x}</td>" for x in xs)
    return f"""<table><tr><!-- 列車種 --><td>列車種</td>{cells(kinds)}</tr><tr class=a>
<!-- 列車名 --><td>列車名</td>{cells(names)}</tr><tr>{days}</tr>
<tr>
<!-- 駅名 --><td>A</td><td>08:00発</td><td>1</td><td>09:00 発</td><td></td></tr>
<tr><!-- 駅名 --><td>B</td><td>レ</td><td></td><td>09:10着<br>09:12発</td><td>12</td></tr>
<tr><!-- 駅名 --><td>C</td><td>08:30着</td></tr>
<tr><!-- 駅名 --><td>D</td><td>08:40着</td><td>3</td></tr></table>"""


def test_two_column_pages(spark):
    main, relay = "新幹線", "リレー"
    made = [
        (1, "main", two(["特急", main], ["X1号", "さくら 401号"])),
        (2, "west", two(["特急", "特急"], [f"{relay}かもめ5号", "かもめ7号"])),
        (3, "main", two(["特急", "特急"], [f"{relay}かもめ5号", "かもめ7号"])),
        (4, "west", two(["特急", main], ["かもめ9号"])),
        (5, "other", two(["特急", main], [])),
        (6, "other", None),
    ]
    rows = pages.two_column_stops(spark.createDataFrame(made, "trip_id long, line string, html string"))
    got = {}
    for r in rows.orderBy("trip_id", "sequence").collect():
        got.setdefault(r["trip_id"], []).append((r["position"], r["name"], r["service"], r["number"], r["sequence"], r["arrival"], r["departure"], r["platform"], r["days"]))
    days = "毎日 & 祝日"
    second = lambda *name: [(1, *name, 1, None, "09:00", None, days), (1, *name, 2, "09:10", "09:12", "12", days)]
    first = lambda *name: [(0, *name, 1, None, "08:00", "1", days), (0, *name, 4, "08:40", None, "3", days)]
    assert got[1] == second("さくら 401号", "Sakura", "401")
    assert got[2] == second("かもめ7号", "Kamome", "7")
    # the main line goes by the type alone
    assert got[3] == first(f"{relay}かもめ5号", f"{relay}かもめ", "5")
    # a list shorter than the column gives its first value
    assert got[4] == second("かもめ9号", "Kamome", "9")
    assert got[5] == first(None, None, None) and 6 not in got


GRID = """<FONT size=4>東京駅　</FONT><FONT size=5>下り</FONT><TABLE><TR><TD nowrap class=S>前の1号<TR><TD nowrap class=MB><B>59</B><TR><TD nowrap class=S>先
<FONT size=4><B>6</B></FONT><TD nowrap class=S>のぞみ1号<TR><TD nowrap class=MA><B>00</B><TR><TD nowrap class=S>博多
<TD nowrap class=S>こだま 701<TR><TD nowrap class=MB><B>7</B><TR><TD nowrap class=S>名古屋
<FONT size=4><B>23</B></FONT><TD nowrap class=S>ライナー12号<TR><TD nowrap class=MB><B>5</B>◆<TR><TD nowrap class=S>三島"""


def test_grid_page(spark):
    rows = pages.grid_departures(spark.createDataFrame([(1, 0, "outbound", GRID), (2, 0, "inbound", None)], "station_id int, day long, direction string, html string"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, "outbound", "06:00", "Nozomi", 1, "博多"), (1, 0, "outbound", "23:05", "ライナー", 12, "三島")]


def test_links_of_services(spark):
    cell = lambda name, n, c="back5": f'<td class={c} nowrap><b>{name}</b><a href="/jr-k_time/2403/0101/{n}.html?c=1&amp;ym=2403&amp;d=1">x</a></td>'
    html = "<table><tr>" + cell("みずほ", 1) + cell("みずほ", 2, "back6") + cell("かもめ", 3) + "<td class=back5b>さくら<a href='/other/4.html'>x</a></td>" + cell("さくら", 5, "back5c") + cell("みずほ", 1) + "</tr></table>"
    rows = spark.createDataFrame([(1, "https://h.org/a/", html)], "page int, url string, html string")
    link = lambda n: f"https://h.org/jr-k_time/2403/0101/{n}.html?c=1&ym=2403&d=1"
    got = lambda services: [(r["place"], r["link"]) for r in pages.service_links(rows, services).orderBy("place").collect()]
    assert got(pages.LINE_SERVICES["main"]) == [(0, link(1)), (1, link(5))] and got(pages.LINE_SERVICES["west"]) == [(0, link(3))]
    assert got([]) == [(0, link(1)), (1, link(3)), (2, link(5))]


def test_white_space_of_any_script(spark):
    made = spark.createDataFrame([("東京　駅 x Y ",)], "name string")
    assert made.select(normal_name(F.col("name"))).first()[0] == "東京駅xy"
    assert made.select(plain_text(F.concat(F.lit("　<b>a</b>　 "), "name"))).first()[0] == "a 東京 駅 x Y"


def test_tokens_of_a_page_are_not_dealt_out(spark):
    """A page is walked through once; only its rows, or its chosen cells, go on."""
    two_columns = spark.createDataFrame([(1, "main", "")], "trip_id long, line string, html string")
    detail = spark.createDataFrame([(1, "", "")], "page long, url string, html string")
    for rows in (pages.detail_stops(detail), pages.detail_trains(detail), pages.two_column_stops(two_columns), pages.service_links(detail, [])):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(coalesce(regexp_extract_all" not in plan and plan.count("MapInArrow") == 1, plan


def test_links_of_a_page_in_parts(spark):
    cell = lambda n: f'<td class=back5><b>さくら</b><a href="/jr-k_time/{n}.html">x</a></td>'
    part = lambda *n: "<table><tr>" + "".join(map(cell, n)) + "</tr></table>"
    rows = spark.createDataFrame([(1, 2, "https://h.org/", part(4, 1, 3)), (1, 1, "https://h.org/", part(1, 2, 1))], "page int, part int, url string, html string")
    got = sorted((r["place"], r["link"]) for r in pages.service_links(rows, []).collect())
    assert got == [(k, f"https://h.org/jr-k_time/{n}.html") for k, n in enumerate((1, 2, 4, 3))]


def test_a_busy_station_has_a_page_in_parts(spark):
    visits = spark.createDataFrame([(t, s, 3, 60 * s + t % 60) for t in (1, 2, 30000, 70000) for s in (1, 2)], "trip_id long, seq long, station_id int, dep int")
    assert service_pages(visits).groupBy("page").count().collect() == [(3, 6)]
