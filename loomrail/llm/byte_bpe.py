"""Byte-level BPE by rank files: a segment tree over byte positions finds the leftmost pair of least rank."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import chunks, table

#: No pair; larger than any rank.
NONE = 1 << 30
#: Pieces of up to this many bytes are merged many at a time, longer ones one at a time.
SHORT = 64
#: Latin letters and ASCII without the separators 1C to 1F: on texts of these alone, the standard library's
#: faster engine gives the same pieces by the second pattern as the Unicode classes do by the first.
LATIN = "".join(chr(i) for i in range(128, 0x250) if chr(i).isalpha())
PLAIN_CHARS = frozenset(LATIN) | {chr(i) for i in range(128) if not 0x1C <= i <= 0x1F}
PLAIN = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^\sA-Za-z{LATIN}0-9]+|\s+(?!\S)|\s+""",
}
#: Pieces remembered in a task before the memory is emptied, and characters of text cut into pieces at once.
REMEMBERED, PART = 400_000, 1 << 20
#: Characters of remembered pieces from which all are forgotten.
HELD = 1 << 26


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, of a rank file (base64 bytes and rank a line)."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each range, one after another."""
    shift = start - (np.cumsum(size) - size)
    return values[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Merges:
    """Ranks of neighbouring token pairs; a pair's rank is that of its joined bytes."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {(self.ids[t[:k]] << 32) | self.ids[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.pair = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE without one; an id below 0 is the end of the piece."""
        key = (a << 32) | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each piece; all trees of one width are advanced together."""
        out: list[bytes] = [b""] * len(pieces)
        width = np.array([1 << max(1, (len(p) - 1).bit_length()) for p in pieces])
        for n in np.unique(width).tolist():
            which = np.flatnonzero(width == n)
            for i in range(0, len(which), 1 << 14):
                part = which[i : i + (1 << 14)]
                ids, alive = self._merge([pieces[p] for p in part], n)
                flat, ends = ids[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(axis=1)) * 4
                for p, a, b in zip(part.tolist(), np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    out[p] = flat[a:b]
        return out

    def _merge(self, pieces: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(m, n)
        place = np.arange(n)
        alive = place[None, :] < size[:, None]
        # one column more at either end stands for the piece's borders
        ids = np.full((m, n + 2), -1, np.int64)
        ids[:, 1:-1] = np.where(alive, self.byte[raw], -1)
        nxt, prv = np.tile(np.arange(1, n + 3), (m, 1)), np.tile(np.arange(-1, n + 1), (m, 1))
        nxt[:, -1] = n + 1
        prv[:, 0] = 0
        nxt[np.arange(m), size] = n + 1
        tree = np.full((m, 2 * n), NONE * n, np.int64)
        pair = np.full((m, n), NONE, np.int64)
        pair[:, :-1] = np.where(alive[:, 1:], self.first[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]], NONE)
        tree[:, n:] = pair * n + place
        for k in range(n - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        row = np.arange(m)
        while True:
            row = row[tree[row, 1] < NONE * n]
            if not len(row):
                return ids[:, 1:-1], alive
            best = tree[row, 1]
            at = best % n + 1
            gone = nxt[row, at]
            after, before = nxt[row, gone], prv[row, at]
            ids[row, at] = best // n
            alive[row, gone - 1] = False
            nxt[row, at] = after
            prv[row, after] = at
            for leaf, rank in ((gone, NONE), (at, self.rank(ids[row, at], ids[row, after])), (before, self.rank(ids[row, before], ids[row, at]))):
                ok = leaf > 0
                rows, k = row[ok], leaf[ok] - 1
                tree[rows, n + k] = (rank if np.isscalar(rank) else rank[ok]) * n + k
                k = (n + k) >> 1
                while len(k) and k[0]:
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                    k = k >> 1

    def encode_long(self, piece: bytes) -> bytes:
        n = 1 << (len(piece) - 1).bit_length()
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        m, pair = len(ids), self.pair
        tree = [NONE * n] * (2 * n)
        for i in range(m - 1):
            tree[n + i] = pair.get((ids[i] << 32) | ids[i + 1], NONE) * n + i
        for k in range(n - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv = list(range(1, m + 1)), list(range(-1, m - 1))

        def put(i: int, rank: int) -> None:
            k = n + i
            tree[k] = rank * n + i
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least

        while (best := tree[1]) < NONE * n:
            at, rank = best % n, best // n
            gone = nxt[at]
            after = nxt[gone]
            ids[at], ids[gone] = rank, -1
            nxt[at] = after
            put(gone, NONE)
            if after < m:
                prv[after] = at
                put(at, pair.get((rank << 32) | ids[after], NONE))
            else:
                put(at, NONE)
            if (before := prv[at]) >= 0:
                put(before, pair.get((ids[before] << 32) | rank, NONE))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; a piece that is a token itself is that token."""
        out = [self.ids[p].to_bytes(4, "little") if p in self.ids else None for p in pieces]
        short = [i for i, (p, o) in enumerate(zip(pieces, out)) if o is None and len(p) <= SHORT]
        for i, o in zip(short, self.encode_short([pieces[i] for i in short])):
            out[i] = o
        return [self.encode_long(p) if o is None else o for p, o in zip(pieces, out)]

    def decode(self, ids: np.ndarray) -> bytes:
        return spread(self.blob, self.start[ids], self.size[ids]).tobytes()


class Places(dict):
    """Piece -> place; a piece that is not there yet gets the next place and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        place = self[piece] = len(self)
        return place


class Encoder:
    """Encodes texts piece by piece and remembers pieces, within bounds."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        self.merges, self.pattern, self.plain = merges, regex.compile(pattern), re.compile(PLAIN[pattern]) if pattern in PLAIN else None
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.places, self.ids, self.start, self.size = Places(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        return (self.plain if self.plain and PLAIN_CHARS.issuperset(text) else self.pattern).findall(text)

    def lookup(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces; new ones are all merged together."""
        if len(self.places) > REMEMBERED or self.held > HELD:
            self.forget()
        at = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        if new := self.places.new:
            self.held += sum(map(len, new))
            got = self.merges.encode([p.encode() for p in new])
            size = np.array([len(g) // 4 for g in got], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), "<u4")])
            self.places.new = []
        return at

    def __call__(self, text: str) -> Iterator[np.ndarray]:
        """Ids of one text in parts, in order; a long text is cut into pieces bit by bit."""
        part: list[str] = []
        size = 0
        for m in self.pattern.finditer(text):
            part.append(m.group())
            size += len(part[-1])
            if size > PART:
                at = self.lookup(part)
                yield spread(self.ids, self.start[at], self.size[at])
                part, size = [], 0
        at = self.lookup(part)
        yield spread(self.ids, self.start[at], self.size[at])

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each of a few texts."""
        pieces = [self.pieces(t) for t in texts]
        at = self.lookup(list(chain.from_iterable(pieces)))
        ids = spread(self.ids, self.start[at], self.size[at])
        ends = np.r_[0, np.cumsum(self.size[at])][np.cumsum([0, *map(len, pieces)])]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield ids[a:b]


def _each(tokens, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(tokens.value), pattern)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            count, ids_of, digest, back = [], [], [], []
            for i, j in chunks(texts, PART):
                for parts in ([x] for x in encoder.many(texts[i:j])) if j > i + 1 else [encoder(texts[i])]:
                    h, d, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                    for ids in parts:
                        n += len(ids)
                        h.update(ids.astype("<u4").tobytes())
                        d.update(encoder.merges.decode(ids))
                        if keep:
                            kept.append(ids.astype(np.int32))
                    count.append(n)
                    digest.append(h.hexdigest())
                    back.append(d.hexdigest())
                    if keep:
                        ids_of.append(np.concatenate(kept))
            columns = [b["_id"], pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if keep:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return run


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row of docs, as it comes.

    Null and empty texts have no tokens. Whole texts are encoded, each match of `pattern`
    separately, without special tokens. decoded_sha256 is of the bytes that the ids decode to.
    rank_file is read by the driver and its tokens (a fixed vocabulary) are broadcast.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_each(tokens, pattern, keep_ids), schema).withColumnRenamed("_id", id_col)


def decoded(ids: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes that each list of ids stands for; a null list gives null."""
    tokens = ids.sparkSession.sparkContext.broadcast(load_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else b"".join(map(tokens.value.__getitem__, x)) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(out, pa.binary())], ["_id", "bytes"])

    rows = ids.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, bytes binary").withColumnRenamed("_id", id_col)


def digest_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
