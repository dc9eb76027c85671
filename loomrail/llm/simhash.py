"""SimHash near-duplicates: pigeonhole blocks of 64-bit fingerprints, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import as_bytes, checkpointed, numbered, table
from loomrail.llm.components import components

#: Shingles hashed at once, so that one long text needs bounded memory.
STEP = 1 << 16
#: Fingerprints of one bucket compared in one matrix; larger buckets are split by further blocks first.
MATRIX = 2048


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority of each bit over the hashes of all shingles; 0 without a word."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, STEP):
        part = w[i : i + STEP + words - 1]
        shingles = zip(*(part[k:] for k in range(words))) if len(w) >= words else [part]
        x = np.array([h(b" ".join(s), seed) for s in shingles], "<u8")
        counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one row for each input row, fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(b["text"])], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - distance out of `blocks` nearly equal blocks of 64 bits."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(part, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks for which chance puts less than about one other fingerprint in a bucket."""
    return next((b for b in range(distance + 1, 17) if 64 * (b - distance) / b >= np.log2(max(n, 2)) + 2), 16)


def _least_near(fps: np.ndarray, label: np.ndarray, distance: int) -> np.ndarray:
    """The least label among each member's links, itself included; compared tile by tile."""
    out = label.copy()
    for i in range(0, len(fps), MATRIX):
        for j in range(0, len(fps), 8 * MATRIX):
            near = np.bitwise_count(fps[i : i + MATRIX, None] ^ fps[None, j : j + 8 * MATRIX]) <= distance
            out[i : i + MATRIX] = np.minimum(out[i : i + MATRIX], np.where(near, label[None, j : j + 8 * MATRIX], len(fps)).min(axis=1))
    return out


def _stars(fps: np.ndarray, distance: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning star for each component of the links within one bucket.

    free: the bits in which the members may differ. Buckets over MATRIX members are split by
    distance + 1 blocks of these bits, which puts linked members in one part again, and so on; a part
    that no split makes smaller is compared in tiles.
    """
    m = len(fps)
    bits = [i for i in range(64) if free >> i & 1]
    if m > MATRIX and len(bits) > 2 * distance + 2:
        us, vs = [], []
        for k in range(distance + 1):
            mask = sum(1 << i for i in bits[k * len(bits) // (distance + 1) : (k + 1) * len(bits) // (distance + 1)])
            key = fps & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, edge):
                if len(part) > 1:
                    u, v = _stars(fps[part], distance, free & ~mask)
                    us.append(u)
                    vs.append(v)
        return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])
    label = np.arange(m)
    while True:
        new = _least_near(fps, label, distance)
        new = np.minimum(new, label[new])
        if (new == label).all():
            break
        label = new
    other = label != np.arange(m)
    return fps[label[other]], fps[other]


def bucket_edges(keyed: DataFrame, distance: int, masks: list[int]) -> DataFrame:
    """Edges (u, v) that connect what is linked within each bucket; keyed: (which, bits, fp), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = tuple(b[c].to_numpy(zero_copy_only=False) for c in ("which", "bits", "fp"))
            held = now if held is None else tuple(map(np.concatenate, zip(held, now)))
            if not len(held[0]):
                continue
            # the last bucket may go on in the next batch
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            end = last[-1] + 1 if len(last) else 0
            yield from out(*(x[:end] for x in held))
            held = tuple(x[end:] for x in held)
        if held is not None:
            yield from out(*held)

    def out(which, bits, fp):
        if len(fp) < 2:
            return
        fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (bits[1:] != bits[:-1])])
        size = np.diff(np.r_[starts, len(fp)])
        us, vs = [], []
        two = starts[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
        us.append(fp[two][near])
        vs.append(fp[two + 1][near])
        for s, n in zip(starts[size > 2], size[size > 2]):
            u, v = _stars(fp[s : s + n], distance, ~masks[which[s]] & (1 << 64) - 1)
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "which", "bits").sortWithinPartitions("which", "bits", "fp").mapInArrow(run, "u long, v long")


def near_classes(prints: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint; classes are joined by links of at most `distance` bits.

    Equal fingerprints are one node. Every choice of blocks - distance blocks is a bucket key, so
    that any close pair shares a bucket; more blocks than distance + 1 make the keys longer and
    the buckets small at any size of the input.
    """
    nodes = checkpointed(prints.select("fp").distinct())
    masks = block_masks(distance, blocks or blocks_for(nodes.count(), distance))
    keys = F.array(*(F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("bits")) for i, m in enumerate(masks)))
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("k.which", "k.bits", "fp")
    roots = components(bucket_edges(keyed, distance, masks))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs.

    A null, empty or blank text has fingerprint 0 and is linked like any other. Texts of fewer
    words than a shingle hash as one sequence. Repeated rows stay repeated. component_id is the
    smallest doc_id of the component, null only if all its ids are null. Other columns of docs
    are not read, whatever their names.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    classes = checkpointed(near_classes(prints, distance))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, distance: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component: the one of smallest id (null last), then of smallest text hash.

    Rows equal in both id and text are one document. All columns of docs are returned, whatever their names.
    """
    named, (i, t) = numbered(docs, id_col, text_col)
    rows = simhash_components(named, i, t, distance=distance, words=words)
    first = rows.groupBy("component_id", "fp", "doc_id", "text_hash").count().groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "fp")).alias("k"))
    stay = first.where("component_id is not null").select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    # components without any id: one for each fingerprint class
    nameless = rows.where("component_id is null").groupBy("fp").agg(F.min("text_hash").alias("_hash")).select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("_id"), "_hash")
    stay = stay.union(nameless)
    kept = named.withColumn("_text_hash", F.xxhash64(t)).join(stay, F.col(i).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates([i, "_text_hash"]).select(*named.columns).toDF(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
