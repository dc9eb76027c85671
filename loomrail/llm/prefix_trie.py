"""Trie of the common beginnings of conversations.

Every conversation is an array of turns, a turn being the SHA-256 of its role and text. The arrays are
range-sorted over all tasks, equal ones by conversation, so that copies of one array may lie in several
ranges. Each range is swept once: the common prefix of neighbours tells which nodes on the stack end.
Nodes that cross the border of a range are given as parts, and one sweep over these parts alone, in
the order of ranges, stitches the open stacks together.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import checkpointed, new_folder, table

#: Bytes of a turn's key.
KEY = 32
#: Turns that one range holds, about, and rows given at once.
RANGE, ROWS = 1 << 17, 1 << 14
#: Ids in one piece of a node that crosses ranges.
PIECE = 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()

#: Nodes, parts of nodes that cross a border, and pieces of the ids that end in these, as one sweep gives them.
FIELDS = [("kind", "string"), ("pid", "int"), ("depth", "bigint"), ("side", "string"), ("conv_id", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string"), ("size", "bigint"), ("through", "boolean"), ("seq", "bigint"), ("ids", "binary")]
TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
SWEPT = ", ".join(f"{n} {t}" for n, t in FIELDS)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Nodes of the stitching: their part "R" lies in range `since`, and a part "L" in each later range up to `until`.
STITCHED = ["since", "until", *NODE[:-1]]


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the start of both."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        # what is known to be equal needs no second look
        if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


def turn_arrays(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as array of (key, size), size being the text's code points.

    Null roles and texts count as empty; a null turn comes first, equal turns go by their keys. Rows
    without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).isNotNull().alias("a"), F.col(turn_col).alias("b"), key.alias("key"), F.char_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(arrays: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family in place of its own, h = crc32(c) % heads.

    The arrays are written down first, as they are read twice.
    """
    folder = new_folder(arrays.sparkSession, "turns")
    arrays.write.parquet(folder)
    arrays = arrays.sparkSession.read.parquet(folder)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    base = arrays.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    own = arrays.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))).alias("rest"))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.expr("slice(rest, 1, 0)")), 1, F.greatest("h", F.lit(1)))).otherwise(F.expr("slice(rest, 1, 0)"))
    return own.join(base, "base", "left").select("conv_id", F.concat(head, "rest").alias("turns"))


@dataclass
class Node:
    """A node on a stack; sums are over what lies below it and has ended."""

    size: int
    conv_id: int
    #: where it began: whether at the left border (sweep), or the range (stitching)
    begin: int
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    #: ids that end here, and rows of children that wait for this node's smallest id
    ends: array = field(default_factory=lambda: array("q"))
    waiting: list = field(default_factory=list)

    def take(self, conv_id: int, n_convs: int, n_children: int, n_leaves: int, saved: int) -> None:
        self.conv_id = min(self.conv_id, conv_id)
        self.n_convs += n_convs
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved

    def finish(self) -> tuple[int, int]:
        """All below it and its own members are known: (leaves, saved tokens) of its subtree."""
        return self.n_leaves or 1, self.saved + (self.n_convs - 1) * self.size


def borders(ranges: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """For each range that has rows, how many turns its first array shares with the range before, and its last with the one after; -1 without one.

    Two arrays of each range go to one task, two numbers to the driver.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = pid = None
        for b in batches:
            if b.num_rows:
                first = b["keys"][0].as_py() if pid is None else first
                pid, last = b["pid"][0].as_py(), b["keys"][b.num_rows - 1].as_py()
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = b""
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pydict({"pid": b["pid"].slice(i, 1), "turns": pa.array([common_turns(before, b["first"][i].as_py())], pa.int64())})
                before = b["last"][i].as_py()

    rows = ranges.select("pid", "keys").mapInArrow(ends, "pid int, first binary, last binary").repartition(1).sortWithinPartitions("pid").mapInArrow(shared, "pid int, turns bigint").collect()
    pids, turns = [r["pid"] for r in rows], [r["turns"] for r in rows]
    return dict(zip(pids, [-1, *turns[1:]])), dict(zip(pids, [*turns[1:], -1]))


def sweep(left: dict[int, int], right: dict[int, int]):
    """A function for mapInArrow over the sorted rows (pid, conv_id, keys, sizes) of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[Node] = []
        pid, last = None, b""

        def close(at_end: bool) -> None:
            node, depth = stack.pop(), len(stack)
            through = at_end and depth <= right[pid]
            side = "L" if node.begin else "R" if through else None
            if side:
                out.append(("part", pid, depth, side, node.conv_id, None, node.n_convs, node.n_children, node.n_leaves, node.saved, None, node.size, through, None, None))
                out.extend(("piece", pid, depth, side, *[None] * 9, at, node.ends[at : at + PIECE].tobytes()) for at in range(0, len(node.ends), PIECE))
            else:
                leaves, saved = node.finish()
                digest = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
                row = ("node", pid, depth, None, node.conv_id, None, node.n_convs, node.n_children, leaves, saved, digest, *[None] * 4)
                if not depth:
                    out.append(row)
                elif stack[-1].begin:
                    out.append((*row[:3], "L", *row[4:]))
                else:
                    stack[-1].waiting.append(row)
                if depth:
                    stack[-1].take(node.conv_id, node.n_convs, 1, leaves, saved)
            out.extend((*row[:3], side, row[4], None if side else node.conv_id, *row[6:]) for row in node.waiting)

        def ready() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(FIELDS)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS])

        for b in batches:
            sizes, places = b["sizes"].flatten().to_numpy(zero_copy_only=False), [0, *np.cumsum(b["sizes"].value_lengths().to_numpy(zero_copy_only=False)).tolist()]
            for i in range(b.num_rows):
                conv, keys, begin = b["conv_id"][i].as_py(), b["keys"][i].as_py(), pid is None
                pid = b["pid"][i].as_py()
                shared = left[pid] if begin else common_turns(last, keys)
                while len(stack) > shared + 1:
                    close(False)
                for depth in range(len(stack), places[i + 1] - places[i] + 1):
                    stack.append(Node(int(sizes[places[i] + depth - 1]) if depth else 0, conv, begin and depth <= shared))
                stack[-1].take(conv, 1, 0, 0, 0)
                stack[-1].ends.append(conv)
                last = keys
                if len(out) >= ROWS:
                    yield ready()
        while stack:
            close(True)
        yield ready()

    return run


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that cross borders, from their parts in the order of ranges: "L" parts from the deepest, then "R" parts from the top.

    Before a range, the stack holds just the nodes that cross its left border.
    """
    stack: list[Node] = []
    for b in batches:
        out = []
        for r in b.to_pylist():
            pid, depth = r["pid"], r["depth"]
            if r["side"] == "R":
                stack.append(Node(r["size"], r["conv_id"], pid))
            node = stack[depth]
            node.take(r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            if not r["through"]:
                stack.pop()
                leaves, saved = node.finish()
                row = [node.begin, pid, node.conv_id, depth, None, node.n_convs, node.n_children, leaves, saved]
                if depth:
                    stack[-1].take(node.conv_id, node.n_convs, 1, leaves, saved)
                    stack[-1].waiting.append(row)
                else:
                    out.append(row)
                out.extend([*w[:4], node.conv_id, *w[5:]] for w in node.waiting)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * len(STITCHED))], STITCHED)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) from the pieces of each node in order; one piece is held at a time."""
    mine = sha = None
    for b in batches:
        out = []
        for i in range(b.num_rows):
            node, ids = (b["conv_id"][i].as_py(), b["depth"][i].as_py()), array("q", b["ids"][i].as_py())
            if node != mine:
                out.extend([(*mine, sha.hexdigest())] if mine else [])
                mine, sha = node, hashlib.sha256()
                sha.update(",".join(map(str, ids)).encode())
            else:
                sha.update(("," + ",".join(map(str, ids))).encode())
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([o[0] for o in out], pa.int64()), "depth": pa.array([o[1] for o in out], pa.int64()), "digest": pa.array([o[2] for o in out], pa.string())})
    if mine:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([mine[0]], pa.int64()), "depth": pa.array([mine[1]], pa.int64()), "digest": pa.array([sha.hexdigest()], pa.string())})


def trie(arrays: DataFrame, ranges: int) -> DataFrame:
    """The nodes of the trie of (conv_id, turns); every conversation is a member of the root, one without turns too.

    Columns are NODE: the smallest member names a node together with its depth; the root's parent is
    null. No conversations give no nodes. A repeated conv_id counts as often as it stands. What one task
    holds is bounded by a range of arrays and by the longest of them. The stitching and the digest of
    one node's ids are chains, which go through one task each, the first over a few rows for each range,
    the other in pieces.
    """
    spark = arrays.sparkSession
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    arrays = arrays.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    ordered = checkpointed(arrays.repartitionByRange(ranges, "keys", "conv_id").sortWithinPartitions("keys", "conv_id").select(F.spark_partition_id().alias("pid"), "conv_id", "keys", "sizes"))
    folder = new_folder(spark, "trie")
    ordered.mapInArrow(sweep(*borders(ordered)), SWEPT).write.parquet(folder)
    swept = spark.read.schema(SWEPT).parquet(folder)
    parts = swept.where("kind = 'part'").select("pid", "depth", "side", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "through")
    in_order = parts.repartition(1).sortWithinPartitions("pid", "side", F.when(F.col("side") == "L", -F.col("depth")).otherwise(F.col("depth")))
    crossing = checkpointed(in_order.mapInArrow(stitch, ", ".join(f"{c} bigint" for c in STITCHED)))
    where = crossing.select(F.explode(F.sequence("since", "until")).alias("pid"), "since", "depth", F.col("conv_id").alias("of")).select(F.col("pid").cast("int"), "depth", F.when(F.col("pid") == F.col("since"), "R").otherwise("L").alias("side"), "of")
    pieces = swept.where("kind = 'piece'").select("pid", "depth", "side", "seq", "ids").join(where, ["pid", "depth", "side"]).select(F.col("of").alias("conv_id"), "depth", "pid", "seq", "ids")
    ends = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "pid", "seq").mapInArrow(digests, "conv_id bigint, depth bigint, digest string")
    across = crossing.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).select(*NODE)
    nodes = swept.where("kind = 'node'")
    below = nodes.where("side IS NOT NULL").join(where.withColumn("depth", F.col("depth") + 1), ["pid", "depth", "side"]).withColumn("parent_conv_id", F.col("of")).select(*NODE)
    return nodes.where("side IS NULL").select(*NODE).unionByName(below).unionByName(across)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    turns = table(spark, sf_dir, "conversations")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.count() // RANGE + 1)
    return trie(rebuilt(turn_arrays(turns)), ranges)


OP12_SQL = """
WITH t AS (SELECT conv_id, turn, length(text) AS size, sha256(length(role)::VARCHAR || ':' || role || text) AS key
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
a AS (SELECT conv_id, list({'k': key, 'n': size} ORDER BY turn NULLS FIRST, key) AS turns FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 6 AS h FROM a),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN a b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
q AS (SELECT conv_id, depth, len(turns) AS n, turns[depth].n AS size, array_to_string(list_transform(turns[1:depth], lambda x: x.k), '') AS node, array_to_string(list_transform(turns[1:depth - 1], lambda x: x.k), '') AS above FROM p),
n AS (SELECT node, depth, min(conv_id) AS conv_id, min(above) AS above, count(*) AS n_convs, min(size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM q GROUP BY node, depth),
c AS (SELECT above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
s AS (SELECT u.node, sum((d.n_convs - 1) * coalesce(d.size, 0)) AS saved, count(*) FILTER (WHERE c.above IS NULL) AS leaves
      FROM n u JOIN n d ON d.depth >= u.depth AND d.node[1:64 * u.depth] = u.node LEFT JOIN c ON c.above = d.node GROUP BY u.node)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN m.conv_id END AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN n m ON m.node = n.above LEFT JOIN c ON c.above = n.node
"""
