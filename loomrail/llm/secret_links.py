"""Credential parts of a text, and weak ones among them only where complementary parts stand nearby.

A text's scopes are its paragraphs, parted by empty lines. Each part has a role: identifier, secret or
endpoint. Spans of the base kinds are reported as they are; a weak one is reported if an interval join
within its scope finds the roles that complete it no further than REACH code points away. A text is one
row, so the join is a merge of that row's sorted parts, and documents need no exchange.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import numbered, table

#: Most code points between two parts that belong together.
REACH = 300
TIED = r"""["']?\x20*[:=]\x20*["']?"""
#: Base kinds in the contract's order: pattern, and the least length of the match or of its group 2.
ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){TIED}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")
#: Weak kinds, earlier ones before later ones where spans overlap: pattern, a text that each match holds, least length of group 2.
WEAK = {
    "id": (re.compile(rf"(user|user_?name|login|account|client_?id|key_?id){TIED}([A-Za-z0-9@._+-]+)", re.I | re.A), "", 3),
    "pass": (re.compile(rf"(password|passwd|secret|token|api_?key|pwd|pass_?phrase|private_?key){TIED}([A-Za-z0-9+/_.=-]+)", re.I | re.A), "", 6),
    "host": (re.compile(rf"(host|host_?name|endpoint|server){TIED}([A-Za-z0-9.:/_-]+)", re.I | re.A), "", 4),
    "url": (re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x20\x09-\x0D\"'<>]+"), "://", 0),
    "mail": (re.compile(r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,64}\.[A-Za-z0-9]+"), "@", 0),
    "ip": (re.compile(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ".", 0),
    "blob": (re.compile(r"[A-Za-z0-9+/_-]{20,}"), "", 0),
}
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "pass": "secret", "host": "endpoint", "url": "endpoint", "mail": "identifier", "ip": "endpoint", "blob": "secret"}
#: What must stand nearby: every role of one of the sets.
NEEDS = {"id": [{"secret"}], "mail": [{"secret"}], "pass": [{"identifier"}, {"endpoint"}], "blob": [{"identifier"}], "host": [{"identifier", "secret"}], "url": [{"identifier", "secret"}], "ip": [{"identifier", "secret"}]}
#: These are marks of a made-up string rather than of a word or number.
MIXED = [re.compile(p) for p in ("[0-9]", "[A-Z]", "[a-z]")]
BREAK = re.compile(r"\n\n+")

PART_TYPE = "struct<kind:string,start:bigint,end:bigint,role:string,partner:string>"
PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("role", pa.string()), ("partner", pa.string())])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str, kinds: list[str]) -> list[tuple[int, int, str]]:
    out = []
    for kind in kinds:
        pattern, held, least = WEAK[kind]
        if held in text:
            for m in pattern.finditer(text):
                if least and m.end(2) - m.start(2) < least or kind == "blob" and not all(p.search(m.group()) for p in MIXED):
                    continue
                out.append((m.start(), m.end(), kind))
    return out


class Intervals:
    """Intervals of one scope and role, by start, with the furthest end up to each."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.spans = sorted(spans)
        self.starts = [s[0] for s in self.spans]
        self.furthest: list[tuple[int, int]] = []
        for i, s in enumerate(self.spans):
            self.furthest.append(max((s[1], i), self.furthest[-1]) if i else (s[1], i))

    def nearest(self, start: int, end: int) -> tuple[int, tuple[int, int, str]] | None:
        """(gap, span) nearest to an interval; of equal ones the earlier."""
        at, out = bisect_left(self.starts, start), []
        if at:
            stop, i = self.furthest[at - 1]
            out.append((max(start - stop, 0), self.spans[i]))
        if at < len(self.spans):
            out.append((max(self.starts[at] - end, 0), self.spans[at]))
        return min(out) if out else None


def overlapping(spans: list[tuple[int, int, str]]) -> list[bool]:
    """Whether each span overlaps one of a kind listed earlier; base kinds never count as such. Kinds have no overlaps of their own."""
    by_kind = {k: Intervals([s for s in spans if s[2] == k]) for k in {s[2] for s in spans}}
    out = []
    for start, end, kind in spans:
        earlier = KINDS[: KINDS.index(kind)] if kind in WEAK else ()
        hit = False
        for k in earlier:
            if k in by_kind:
                held = by_kind[k]
                at = bisect_right(held.starts, start)
                hit = hit or bool(at and held.spans[at - 1][1] > start) or bool(at < len(held.starts) and held.starts[at] < end)
        out.append(hit)
    return out


def parts_of(text: str, reach: int = REACH) -> list[dict]:
    """All base spans and the weak ones that are completed, by start, then kind as listed."""
    base = base_spans(text)
    found = weak_spans(text, ["id", "host", "url", "mail", "ip"])
    # a weak secret is never reported without an identifier or an endpoint, nor are those without a secret
    if found or any(s[2] == "access" for s in base):
        found += weak_spans(text, ["pass", "blob"])
    spans = base + found
    spans = [s for s, hit in zip(spans, overlapping(spans)) if not hit]
    if not found or len(spans) == len(base):
        return [{"kind": k, "start": s, "end": e, "role": ROLE[k], "partner": None} for s, e, k in base]
    breaks = [m.start() for m in BREAK.finditer(text)]
    groups: dict[tuple[int, str], list] = {}
    for s in spans:
        # a number alone is no secret
        if s[2] != "hex" or not text[s[0] : s[1]].isdigit():
            groups.setdefault((bisect_left(breaks, s[0]), ROLE[s[2]]), []).append(s)
    held = {key: Intervals(v) for key, v in groups.items()}
    out = []
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        partner = None
        if kind in WEAK:
            scope, near = bisect_left(breaks, start), {}
            for role in {r for need in NEEDS[kind] for r in need}:
                got = held[scope, role].nearest(start, end) if (scope, role) in held else None
                if got and got[0] <= reach:
                    near[role] = got
            if not any(need <= near.keys() for need in NEEDS[kind]):
                continue
            s, e, k = min(near.values())[1]
            partner = f"{k}:{s}:{e}"
        out.append({"kind": kind, "start": start, "end": end, "role": ROLE[kind], "partner": partner})
    return out


def credential_parts(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """docs with one more column, `parts`: array of (kind, start, end, role, partner), offsets in code points, end exclusive.

    Kinds of base and weak parts and their order are KINDS; partner is the nearest part that completes a
    weak one, as kind:start:end, null for base parts. Whole texts are searched, however long; a null or
    empty text has an empty array. Every row is kept, repeated ones too; an empty table gives no rows.
    Other columns pass, whatever their names; one called `parts` or `text` other than text_col is no clash.
    """
    names = docs.columns
    plain, (text,) = numbered(docs, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [parts_of(t or "", reach) for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(PART))], names=[*b.schema.names, "parts"])

    return plain.mapInArrow(scan, f"{schema}, parts array<{PART_TYPE}>").toDF(*names, "parts")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; a row for each row of documents."""
    found = credential_parts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "parts")
    is_base = lambda p: p["kind"].isin(*BASE)
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("parts", is_base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("parts")).alias("spans"))


def _spelled(word: str) -> str:
    """A word in letters of either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    """Spans by cutting each text at a kind's matches; parts that complete one another by a join of each text's spans."""
    tied = "[\"'']?\\x20*[:=]\\x20*[\"'']?"
    keys = lambda *words: "(" + "|".join(map(_spelled, words)) + ")"
    value = r"([A-Za-z0-9+/_.=-]+)"
    kinds = [
        ("assign", keys("password", "passwd", "secret", "token", "api_?key") + tied + value, 12),
        ("access", "AKIA[A-Z0-9]{14,}", 0),
        ("hex", "[0-9a-f]{16,}", 0),
        ("id", keys("user", "user_?name", "login", "account", "client_?id", "key_?id") + tied + "([A-Za-z0-9@._+-]+)", 3),
        ("pass", keys("password", "passwd", "secret", "token", "api_?key", "pwd", "pass_?phrase", "private_?key") + tied + value, 6),
        ("host", keys("host", "host_?name", "endpoint", "server") + tied + "([A-Za-z0-9.:/_-]+)", 4),
        ("url", "[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\\x20\\x09-\\x0D\"''<>]+", 0),
        ("mail", r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,64}\.[A-Za-z0-9]+", 0),
        ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0),
        ("blob", "[A-Za-z0-9+/_-]{20,}", 0),
    ]
    cut = lambda pattern, group: f"regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs, regexp_extract_all(t, '{pattern}', {group}) AS vs"
    found = " UNION ALL ".join(f"SELECT row, '{k}' AS kind, {i} AS o, {least} AS least, {cut(p, 2 if least else 0)} FROM d" for i, (k, p, least) in enumerate(kinds))
    places = "unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0)))::BIGINT"
    reach = " OR ".join(f"kind IN ({names}) AND {need}" for names, need in (("'id', 'mail'", "secret"), ("'pass'", "(identifier OR endpoint)"), ("'blob'", "identifier"), ("'host', 'url', 'ip'", "identifier AND secret")))
    near = lambda role: f"coalesce(bool_or(q.role = '{role}' AND q.a - p.e <= {REACH} AND p.a - q.e <= {REACH}), false) AS {role}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
x AS (SELECT row, kind, o, least, {places} AS a, unnest(ms) AS m, unnest(vs) AS v FROM f WHERE len(ms) > 0),
y AS (SELECT row, kind, o, a, a + length(m) AS e, m FROM x WHERE length(v) >= least AND (kind <> 'blob' OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')))),
b0 AS (SELECT row, regexp_extract_all(t, '\\n\\n+') AS ms, regexp_split_to_array(t, '\\n\\n+') AS gs FROM d WHERE row IN (SELECT row FROM y)),
b AS (SELECT row, {places} AS a FROM b0 WHERE len(ms) > 0),
s AS (SELECT y.*, CASE WHEN kind IN ('access', 'id', 'mail') THEN 'identifier' WHEN kind IN ('assign', 'hex', 'pass', 'blob') THEN 'secret' ELSE 'endpoint' END AS role, (SELECT count(*) FROM b WHERE b.row = y.row AND b.a < y.a) AS scope FROM y
      WHERE o < 3 OR NOT EXISTS (SELECT 1 FROM y z WHERE z.row = y.row AND z.o < y.o AND z.a < y.e AND y.a < z.e)),
n AS (SELECT p.row, p.kind, p.o, p.a, p.e, {near('identifier')}, {near('secret')}, {near('endpoint')}
      FROM s p LEFT JOIN s q ON q.row = p.row AND q.scope = p.scope AND q.role <> p.role AND NOT (q.kind = 'hex' AND regexp_full_match(q.m, '[0-9]+')) WHERE p.o > 2 GROUP BY ALL),
r AS (SELECT row, kind, o, a, e FROM s WHERE o < 3 UNION ALL SELECT row, kind, o, a, e FROM n WHERE {reach}),
g AS (SELECT row, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS spans FROM r GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.row = d.row"""


OP13_SQL = _sql()
