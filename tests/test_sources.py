"""Documents of any form, tiles, archives and their edges."""

import json
import random

from pyspark.sql import functions as F

from loomrail.operators import tiles
from loomrail.sources import archives, documents

FIELDS = "sequence int, station_id string"
TRAINS = [{"train_number": str(n), "stop_times": [{"sequence": k, "station_id": f"S{n}{k}"} for k in (1, 2)]} for n in range(3)]


def test_documents_of_any_form(spark, tmp_path):
    lines = "\n".join(map(json.dumps, TRAINS))
    made = {
        "lines.json": lines,
        "spaced.json": "\n  \n" + lines + "\n\n{broken\n",
        "object.json": json.dumps({"label": "x", "train_instances": TRAINS}, indent=2),
        "flat.json": json.dumps({"train_instances": TRAINS}),
        "list.json": json.dumps(TRAINS, indent=4),
        "flat_list.json": json.dumps(TRAINS),
        "one.json": json.dumps(TRAINS[0], indent=1),
        "cut.json": json.dumps({"train_instances": TRAINS}, indent=2)[:-40],
        "other.json": json.dumps({"stations": [1, 2]}, indent=2),
        "none.json": json.dumps({"train_instances": []}, indent=2),
        "empty.json": "",
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text)
    got = documents.read_trains(spark, str(tmp_path), FIELDS)
    found = {}
    for r in got.rows.collect():
        found.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["train_number"], r["sequence"], r["station_id"]))
    every = sorted((t["train_number"], s["sequence"], s["station_id"]) for t in TRAINS for s in t["stop_times"])
    assert {k: sorted(v) for k, v in found.items()} == {k: every[:2] if k == "one.json" else every for k in ("lines.json", "spaced.json", "object.json", "flat.json", "list.json", "flat_list.json", "one.json")}
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in got.rejected.collect()) == [("cut.json", "broken"), ("other.json", "other"), ("spaced.json", "broken")]
    assert [r["record"] for r in got.rejected.collect() if r["path"].endswith("spaced.json")] == ["{broken"]


def test_sources_may_be_absent_or_whole(spark, tmp_path):
    assert documents.optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "some.json").write_text('{\n "a": 1\n}\n')
    assert [tuple(r) for r in documents.optional(spark, str(tmp_path / "some.json"), "a int").collect()] == [(1,)]


def test_tiles_of_boxes_on_edges(spark):
    rng = random.Random(6)
    grid = lambda low, width: rng.choice([low + width * rng.randint(-3, 67) / 64, rng.uniform(low - 1, low + width + 1)])
    boxes = []
    for i in range(300):
        x, y = sorted((grid(tiles.WEST, 18.5), grid(tiles.WEST, 18.5))), sorted((grid(tiles.SOUTH, 16.5), grid(tiles.SOUTH, 16.5)))
        if i % 3:
            x[1], y[1] = x[0], y[0]
        boxes.append((i, x[0], y[0], x[1], y[1]))
    rows = spark.createDataFrame(boxes, "id int, min_lon double, min_lat double, max_lon double, max_lat double")
    got = sorted(tuple(r) for r in tiles.pyramid(rows, (2, 4)).select("id", "z", "x", "y").collect())
    want = []
    for i, x0, y0, x1, y1 in boxes:
        for z in (2, 3, 4):
            n = 2**z
            for x in range(n):
                for y in range(n):
                    w, e = 128.0 + 18.5 * (x / n), 128.0 + 18.5 * ((x + 1) / n)
                    s, top = 46.5 - 16.5 * ((y + 1) / n), 46.5 - 16.5 * (y / n)
                    if not (x1 < w or x0 > e or y1 < s or y0 > top):
                        want.append((i, z, x, y))
    # a box outside all of the finest tiles meets none above either
    assert got == sorted(want)


def test_hot_tiles_are_dealt(spark, tmp_path):
    rows = spark.range(900).select(F.lit("a").alias("layer"), F.lit(3).alias("z"), (F.col("id") % 90 == 0).cast("int").alias("x"), F.lit(1).alias("y"), F.concat(F.lit("f"), "id").alias("feature"))
    # small parts are put together again unless that is turned off
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = documents.write_tiles(rows, str(tmp_path / "t"), most=100)
        assert [tuple(r) for r in manifest.collect()] == [("a", 3, 2, 900)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "layer=a" / "z=3" / "x=0" / "y=1").glob("part-*"))) > 1


def test_archives_by_charset_and_filter(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as a:
        a.writestr("http://h.org/1", "<meta charset=EUC-JP>東京".encode("euc-jp"))
        a.writestr("http://h.org/2", "plain é".encode())
        a.writestr("http://o.org/3", '<meta charset="no-such">x'.encode())
        a.writestr("http://o.org/4", "東京".encode("euc-jp"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as b:
        b.writestr("http://h.org/5", "<p>五</p>".encode("shift_jis"))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    rows = archives.mirrored(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    got = {(r["archive"], r["url"]): tuple(r)[2:] for r in rows.collect()}
    assert got == {
        ("a.zip", "http://h.org/1"): ("euc-jp", "<meta charset=EUC-JP>東京", None),
        ("a.zip", "http://h.org/2"): ("utf-8", "plain é", None),
        ("a.zip", "http://o.org/3"): ("no-such", None, "unknown charset"),
        ("a.zip", "http://o.org/4"): ("utf-8", None, "bytes of another charset"),
        ("b.zip", "http://h.org/5"): ("utf-8", None, "bytes of another charset"),
        ("c.zip", None): (None, None, "broken archive"),
    }
    assert [r["text"] for r in archives.mirrored(spark, str(tmp_path), "shift_jis").where("url = 'http://h.org/5'").collect()] == ["<p>五</p>"]
    chosen = rows.where("url LIKE 'http://h.org/%' AND url IN ('http://h.org/2', 'http://o.org/3')")
    plan = spark._sc._jvm.PythonSQLUtils.explainString(chosen._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [StringStartsWith(url,http://h.org/), In(url, [http://h.org/2,http://o.org/3])]" in plan
    assert [r["url"] for r in chosen.collect()] == ["http://h.org/2"]
    # the source itself leaves the other entries out; Spark only looks for nulls
    assert "Condition : isnotnull(url" in plan and "Condition : (" not in plan
    assert archives.mirrored(spark, str(tmp_path / "none")).count() == 0


def test_archives_written_and_read(spark, tmp_path):
    made = [(f"http://h.org/{i}", f"<p>{i} 漢字 é 🙂</p>" if i else None) for i in range(30)]
    told = archives.write_archives(spark.createDataFrame(made, "url string, html string"), str(tmp_path / "m"), "euc-jp", 4).collect()
    assert sum(r["pages"] for r in told) == 30 and {r["archive"] for r in told} == {p.name for p in (tmp_path / "m").iterdir()}
    texts = {r["url"]: r["text"] for r in archives.mirrored(spark, str(tmp_path / "m")).collect()}
    assert texts["http://h.org/7"] == '<meta charset="euc-jp"><p>7 漢字 é &#128578;</p>' and texts["http://h.org/0"] == '<meta charset="euc-jp">' and len(texts) == 30
