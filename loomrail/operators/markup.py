"""Links, titles and cells of timetable pages, by regular expressions that both engines share."""

QUERIES = {
    "html_metadata_cells": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM {pages}",
    "time_cell_parse": """
SELECT trip_id, seq, nullif(regexp_extract(cell, '([0-9]+:[0-9][0-9]) Arr', 1), '') AS arrival, nullif(regexp_extract(cell, '([0-9]+:[0-9][0-9]) Dep', 1), '') AS departure FROM (
  SELECT trip_id, seq, CASE WHEN event_id % 5 = 0 THEN 'pass' ELSE concat(CASE WHEN event_id % 2 = 0 THEN concat(CAST(minute % 24 AS [[STRING||VARCHAR]]), ':05 Arr. ') ELSE '' END, CAST(dep % 24 AS [[STRING||VARCHAR]]), ':10 Dep.') END AS cell FROM {st}) a WHERE cell NOT LIKE '%pass%'""",
}
