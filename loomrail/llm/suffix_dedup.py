"""Removal of byte strings that repeat anywhere in the corpus, by a sparse suffix array sorted in tasks.

Every window of 200 bytes has an anchor: its leftmost 64-byte gram of least hash, so equal windows
have equal anchors at equal offsets. Spark counts the grams; only repeated ones go on. Their
contexts (136 bytes before, 200 from the anchor on) are dealt out by gram, and in each task the
suffixes that start at anchors, and the reversed prefixes that end there, are put in order by
deep-shallow sorting. Two windows at offset o are equal where the suffixes share 200 - o bytes and
the prefixes o bytes, which the common prefixes of neighbours in both orders decide exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import as_bytes, checkpointed, chunks, numbered, table
from loomrail.llm.suffix_sort import deep_shallow, neighbour_lcp

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM
#: Depth in bytes to which multikey quicksort goes before blind tries take over.
SHALLOW = 96
#: Bytes hashed at once, and contexts sorted at once.
CHUNK, SORTED = 1 << 20, 1 << 15
#: Bits of a place among bytes hashed at once; hashes are cut by as many everywhere, so that equal windows choose alike.
PLACE = (2 * CHUNK).bit_length()
#: Grams with more occurrences than this, and than one for each 2^20 bytes of text, are resolved window by window, which
#: needs no group in one task. There can't be more of them than 2^20.
HOT = 1 << 16
#: Parts that the occurrences of one hot window are dealt over.
SALTS = 16
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of all windows of a byte array, by prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(2 * len(data), CHUNK) + 1
            self.up, self.down = _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return _mixed((sums[width:] - sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all LENGTH-byte windows that lie within one text; texts stand one after another."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hasher.windows(hasher.prefix(data), GRAM)
    w = REACH + 1
    # the top bits of the hash and then the place, so that one minimum finds the leftmost least gram
    n = len(h)
    place = np.arange(n, dtype=np.uint64)
    low = np.uint64(PLACE)
    key = (h >> low << low) | place
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - LENGTH + 1
    least = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    least = least[np.cumsum(inside)[:windows] > 0]
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = least[np.r_[True, least[1:] != least[:-1]]]
    at = np.unique((least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64))
    return at, h[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        texts = as_bytes(b["text"])
        for i, j in chunks(texts, CHUNK):
            size = np.array([len(t) for t in texts[i:j]], np.int64)
            ends = np.cumsum(size)
            data, last = np.frombuffer(b"".join(texts[i:j]), np.uint8), -1
            # a long text goes bit by bit; an anchor depends on its window only, and anchors come in order
            for f in range(0, max(len(data) - LENGTH, 0) + 1, CHUNK) if j == i + 1 else [0]:
                part = data[f : f + CHUNK + LENGTH - 1] if j == i + 1 else data
                bounds = (np.zeros(1, np.int64), np.array([len(part)])) if j == i + 1 else (ends - size, ends)
                at, h = anchors(part, *bounds, hasher)
                new = at + f > last
                at, h = at[new] + f, h[new]
                if len(at):
                    last = int(at[-1])
                    row = np.searchsorted(ends, at, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b["_k"].take(pa.array(row + i)), pa.array((at - (ends - size)[row]).astype(np.int64))], ["h", "k", "pos"])


def _context_id(before: bytes, after: bytes) -> bytes:
    return hashlib.blake2b(bytes([len(before)]) + before + after, digest_size=16).digest()


def _contexts(with_texts: bool, text_col: str):
    """(h, before, after, n), equal contexts met together counted, or (cid, k, pos), of the listed anchors of each text; before is reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys, at, grams = as_bytes(b[text_col]), b["_k"].to_pylist(), b["_at"].to_pylist(), b["_grams"].to_pylist()
            for i, j in chunks([b" " * (len(p) * 400) for p in at], 8 << 20):
                held: dict[tuple, int] = {}
                cid, ks, pos = [], [], []
                for r in range(i, j):
                    t = texts[r]
                    for p, g in zip(at[r], grams[r]):
                        x, y = t[max(0, p - REACH) : p][::-1], t[p : p + LENGTH]
                        if with_texts:
                            held[g, x, y] = held.get((g, x, y), 0) + 1
                        else:
                            cid.append(_context_id(x, y))
                            ks.append(keys[r])
                            pos.append(p)
                if with_texts:
                    h, before, after = zip(*held) if held else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(list(held.values()), pa.int64())], ["h", "before", "after", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(ks, pa.binary()), pa.array(pos, pa.int64())], ["cid", "k", "pos"])

    return run


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def repeated_reach(group: np.ndarray, before: list[bytes], after: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct context, how far repeated windows reach back and on from its anchor (0, 0 if none does).

    group: the gram of each context, which keeps the sorting of one gram apart from that of others.
    many: contexts that occur more than once, all of whose windows repeat.
    """
    n = len(group)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = [np.array([len(x) for x in side], np.int64) for side in (before, after)]
    ranks = []
    for side, width, length in ((before, REACH, size[0]), (after, LENGTH, size[1])):
        rows = _matrix(side, width)
        order = deep_shallow(rows, length, group, SHALLOW)
        lcp = neighbour_lcp(rows, length, order)
        lcp[np.r_[True, group[order][1:] != group[order][:-1]]] = -1
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append((lcp, rank))
    (lcp_b, rank_b), (lcp_a, rank_a) = ranks
    for o in range(REACH + 1):
        fits = (size[0] >= o) & (size[1] >= LENGTH - o)
        key = np.cumsum(lcp_a < LENGTH - o)[rank_a] * (n + 1) + np.cumsum(lcp_b < o)[rank_b]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = fits & (twice | many)
        left[hit] = o
        right = np.where(hit & (right == 0), LENGTH - o, right)
    return left, right


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts come grouped by gram; whole groups are gathered up to SORTED contexts and resolved together."""

    def out(h, before, after, many):
        left, right = repeated_reach(h, before, after, many)
        hit = np.flatnonzero(right)
        if len(hit):
            cid = [_context_id(before[i], after[i]) for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), pa.array(left[hit]), pa.array(right[hit])], ["cid", "back", "on"])

    h, before, after, many = np.zeros(0, np.int64), [], [], np.zeros(0, bool)
    for b in batches:
        h = np.concatenate([h, b["h"].to_numpy(zero_copy_only=False)])
        before += b["before"].to_pylist()
        after += b["after"].to_pylist()
        many = np.concatenate([many, b["n"].to_numpy(zero_copy_only=False) > 1])
        while len(h) > SORTED:
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            cuts = cuts[(cuts >= SORTED) | (cuts == (cuts[-1] if len(cuts) else 0))][:1]
            if not len(cuts):
                break
            c = int(cuts[0])
            yield from out(h[:c], before[:c], after[:c], many[:c])
            h, before, after, many = h[c:], before[c:], after[c:], many[c:]
    if len(h):
        yield from out(h, before, after, many)


def _hot_windows(text_col: str):
    """(window, k, pos): a digest of every LENGTH-byte window around the hot anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, k, at in zip(as_bytes(b[text_col]), b["_k"].to_pylist(), b["_at"].to_pylist()):
                start = sorted({s for p in at for s in range(max(0, p - REACH), min(p, len(t) - LENGTH) + 1)})
                for i in range(0, len(start), 1 << 16):
                    part = start[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(t[s : s + LENGTH], digest_size=16).digest() for s in part], pa.binary()), pa.array([k] * len(part), pa.binary()), pa.array(part, pa.int64())], ["window", "k", "pos"])

    return run


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _k, half of the SHA-256 of the text, which stands for the text in joins; null counts as empty."""
    half = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 32))
    # never null, so that inner and outer joins read the same exchange
    return docs.withColumn("_k", F.coalesce(half, F.lit(b"")))


def copies_of(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, _copies, _least): how many rows have a text, and the least of their ids."""
    small = rows.select("_k", F.col(id_col).alias("_id"))
    return small.groupBy("_k").agg(F.count("*").alias("_copies"), F.min("_id").alias("_least"))


def repeated_spans(rows: DataFrame, copies: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, _spans): the merged byte ranges to remove of every text that occurs once and has any.

    rows: documents with _k. A text with copies stands once among the texts searched, so that parts
    of it count elsewhere too. All columns of rows go through the exchange by _k and into the tasks,
    so that a later join of rows by _k finds the same exchange and the texts are dealt out once.
    """
    long = rows.where(F.octet_length(text_col) >= LENGTH).select("_k", F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    found = long.mapInArrow(_anchor_rows, "h long, k binary, pos long")
    twice = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    limit = max(HOT, total >> 20)
    # hot grams (2^20 at most, of 8 bytes) part from the others before the join, which no hot key is in then
    flagged = found.join(F.broadcast(twice.where(F.col("n") > limit).select("h", F.lit(True).alias("hot"))), "h", "left")
    # hot occurrences have a key of their own there, which nothing waits for
    spread = flagged.withColumn("j", F.when(F.col("hot"), F.xxhash64("k", "pos")).otherwise(F.col("h")))
    cold = twice.where(F.col("n") <= limit).select(F.col("h").alias("j"), F.lit(True).alias("cold"))
    every = spread.join(cold, "j", "left").where("hot or cold").select("k", "h", "pos", F.coalesce("hot", F.lit(False)).alias("_hot"))
    listed = every.groupBy(F.col("k").alias("_k"), "_hot").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("p"))
    chosen = checkpointed(listed.join(copies, "_k").select("_k", "_hot", "_least", F.col("p.pos").alias("_at"), F.col("p.h").alias("_grams")))
    # two comparisons, as an equality would become a key of the joins and take them to another exchange
    least = ((F.col(id_col) >= F.col("_least")) & (F.col(id_col) <= F.col("_least"))) | (F.col(id_col).isNull() & F.col("_least").isNull())
    texts = rows.join(chosen.where("not _hot"), "_k").where(least)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by gram at once: the grouping by context and the sorting by gram find their rows there
    dealt = texts.mapInArrow(_contexts(True, text_col), "h long, before binary, after binary, n long").repartition(n, "h")
    distinct = dealt.groupBy("h", "before", "after").agg(F.sum("n").alias("n"))
    reach = distinct.sortWithinPartitions("h").mapInArrow(_sorted_groups, "cid binary, back long, on long")
    placed = texts.mapInArrow(_contexts(False, text_col), "cid binary, k binary, pos long").join(reach, "cid")
    ranges = placed.select("k", (F.col("pos") - F.col("back")).alias("s"), (F.col("pos") + F.col("on")).alias("e"))
    windows = rows.join(chosen.where("_hot"), "_k").where(least).mapInArrow(_hot_windows(text_col), "window binary, k binary, pos long")
    one = F.xxhash64("k", "pos")
    # one window may stand in any number of texts, so its occurrences are dealt over parts that each get the answer
    seen = windows.groupBy("window").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hot = windows.withColumn("salt", F.pmod(one, F.lit(SALTS)).cast("int")).join(seen, ["window", "salt"]).select("k", F.col("pos").alias("s"), (F.col("pos") + LENGTH).alias("e"))
    merged = ranges.union(hot).groupBy(F.col("k").alias("_k")).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("r"))
    # consecutive ranges that touch or overlap become one
    join = F.aggregate("r", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))))
    return merged.join(copies.where("_copies = 1"), "_k", "left_semi").select("_k", join.alias("_spans"))


def _kept(spans: Column, whole: Column, data: Column, piece=lambda x: x) -> Column:
    """What lies between the spans, each piece by itself, put together; data where there are none."""
    empty = piece(F.lit(b""))
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("kept"))
    parts = F.aggregate(spans, start, lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["kept"], piece(F.substring(data, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")))).alias("kept")))
    return F.when(whole, empty).when(spans.isNotNull(), F.concat(parts["kept"], piece(F.substring(data, (parts["at"] + 1).cast("int"), F.octet_length(data)))))


def _edited(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """rows with _spans and _whole, and the two as columns: the spans to cut, and whether all of a text goes. rows has _k and no other name with an underscore."""
    copies = copies_of(rows, id_col, text_col)
    spans = repeated_spans(rows, copies, id_col, text_col)
    edits = spans.withColumn("_whole", F.lit(False)).unionByName(copies.where("_copies > 1").select("_k", F.lit(None).cast(spans.schema["_spans"].dataType).alias("_spans"), F.lit(True).alias("_whole")))
    whole = F.coalesce(F.col("_whole"), F.lit(False)) & (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) >= LENGTH)
    return rows.join(edits, "_k", "left"), F.col("_spans"), whole


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and rest, the bytes that stay; rest is null where nothing goes.

    Bytes are judged on the input. Null and empty texts, and those under 200 bytes, lose nothing. A
    text of 200 bytes or more with a copy goes wholly, in all copies. Every row stays, and all columns
    pass through, but for older ones of the four names.
    """
    named, (i, t) = numbered(docs, id_col, text_col)
    edited, spans, whole = _edited(keyed(named, t), i, t)
    data = F.coalesce(F.col(t), F.lit("")).cast("binary")
    out = edited.withColumn("_rest", _kept(spans, whole, data))
    size = F.octet_length(data)
    removed = F.when(F.col("_rest").isNotNull(), size - F.octet_length("_rest")).otherwise(0)
    n_spans = F.when(whole, 1).otherwise(F.coalesce(F.array_size(spans), F.lit(0)))
    new = {"n_bytes": size.cast("long"), "n_removed": removed.cast("long"), "n_spans": n_spans.cast("long"), "rest": F.col("_rest")}
    old = [F.col(c).alias(name) for c, name in zip(named.columns, docs.columns) if name not in new]
    return out.select(*old, *(c.alias(name) for name, c in new.items()))


def _valid(piece: Column) -> Column:
    """A piece as text without the characters that its ends cut; characters U+FFFD of the text itself stay."""
    marked = F.replace(F.replace(piece.cast("string"), F.lit("\ufffe"), F.lit("\ufffeb")), F.lit("\ufffd"), F.lit("\ufffea"))
    clean = F.replace(F.make_valid_utf8(marked), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(clean, F.lit("\ufffea"), F.lit("\ufffd")), F.lit("\ufffeb"), F.lit("\ufffe"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every repeated 200-byte string cut out of text, and n_chars (if there) counted anew; all other columns as they are.

    A character that a cut leaves incomplete goes with it. A text with copies becomes empty in all
    of them (keep one first if one should stay). Rows whose text becomes empty are dropped; rows
    that were null or empty before stay as they are.
    """
    named, (i, t) = numbered(docs, id_col, text_col)
    edited, spans, whole = _edited(keyed(named, t), i, t)
    out = edited.withColumn("_new", _kept(spans, whole, F.col(t).cast("binary"), _valid)).where("_new is null or octet_length(_new) > 0")
    text = F.coalesce(F.col("_new"), F.col(t))
    columns = []
    for c, name in zip(named.columns, docs.columns):
        new = text if name == text_col else F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.char_length("_new").cast(named.schema[c].dataType)) if name == chars_col else F.col(c)
        columns.append(new.alias(name))
    return out.select(*columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("rest", F.coalesce("text", F.lit("")).cast("binary")), 256)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))
