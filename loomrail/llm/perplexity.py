"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of each language, counted by Spark.

Words follow words by interpolated modified Kneser-Ney: bigrams, below them the number of different
words before a word, and below that the spelling of the word by a Kneser-Ney model of characters. Texts
are dealt into two folds, near copies into one, and each text is scored by the model of the other fold,
so that no text, and no copy of one, vouches for itself.

One pass turns the texts into blocks of bounded size, of one fold each: the words of the block, and
each document as a sequence of them. Blocks hand in their bigrams as sorted arrays of hashes by
range of hash, and get back how often each stands in either fold; one block owns each bigram and adds it
to the sums of its words, which go the same way once more. An n-gram of characters is known by its code
points, 21 bits for each, and counted and estimated by joins and windows. Nothing of the model is
collected; each block gets the counts that it needs and scores its documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrail.llm.common import bucketed, checkpointed, chunks, table

#: Characters of an n-gram, bits of each, and the marks of a word's end and begin, which are no code points.
ORDER, BITS = 3, 21
END, BEGIN = 0x110001, 0x110002
#: Bytes of text in a block (a longer text is a block of its own), and words spelled at once.
BLOCK, SPELLED = 10 << 20, 1 << 15
#: Bands: so many distances to the nearer quartile of the log perplexity from its median, by language. On sf0.1 all but 2 % of
#: the rows lay from -5 to 6, near copies that the folds part from -16 to -8, words with signs stuck to them from 9 on;
#: planted texts of the 14 commonest words lay below -14, random letters above 24.
BELOW, ABOVE = 11.0, 10.0
#: Least number of ranges of hashes, and bytes of packed word sequences for each range where there are more.
RANGES, RANGE = 32, 8 << 20
MIN_WORDS, MAX_REPEATED = 50, 50
SPACE = "\t\n\x0b\x0c\r "
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Sums of a word in a fold: occurrences before another word, of those followed once, twice and more by the same, and words before it.
SUMS = 5


def model_of(lang: str | None) -> str:
    """The model's name: each language has one, and so have rows without a language."""
    return "-" if lang is None else f"={lang}"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) of each predicted character, the end included: the gram is the character after up to ORDER - 1 before it."""
    texts = [w.decode("utf-8", "replace") for w in words]
    size = np.array([len(t) for t in texts], np.int64) + 2
    start = np.cumsum(size) - size
    codes = np.full(int(size.sum()), END, np.int64)
    codes[start] = BEGIN
    inner = np.ones(len(codes), bool)
    inner[start] = inner[start + size - 1] = False
    codes[inner] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    place = np.arange(len(codes)) - np.repeat(start, size)
    h = codes.copy()
    for k in range(1, ORDER):
        h[k:] |= np.where(place[k:] >= k, codes[:-k] << BITS * k, 0)
    return np.repeat(np.arange(len(words)), size)[place >= 1], h[place >= 1]


class Words(dict):
    """Word -> place in the block's list of words, which all languages share."""

    def __init__(self, model: str, held: list[tuple[str, bytes]]) -> None:
        super().__init__()
        self.model, self.held = model, held

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self.held)
        self.held.append((self.model, word))
        return place


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        _, two = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
        key = two[:-1] << 32 | ids[2:]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    covered = np.zeros(len(ids) + 1, np.int64)
    for at in (order[1:][same], order[:-1][same]):
        for j in range(3):
            covered[at + j] = 1
    return int(covered[:-1].sum())


def discounts(n1, n2, n3, n4) -> tuple[float, float, float]:
    """What is taken off counts of one, two and more, from how many n-grams have each count."""
    n1, n2, n3, n4 = (max(float(n), 1.0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.1, [0.9, 1.9, 2.9]).tolist())


def _packed(batch: pa.RecordBatch, level: int = 4) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of equally long columns, byte by byte of all numbers so that what is small compresses."""
    width = [max((int(c.max(initial=0)).bit_length() + 7) // 8, 1) for c in columns]
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, width)]
    return bytes(width) + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def unpack(data: bytes, columns: int, n: int) -> list[np.ndarray]:
    """The columns of pack; n is how many numbers each has."""
    width = list(data[:columns])
    raw = np.frombuffer(pa.Codec("zstd", 1).decompress(data[columns:], sum(width) * n, asbytes=True), np.uint8)
    out, at = [], 0
    for w in width:
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = raw[at : at + w * n].reshape(w, n).T
        out.append(c.reshape(-1).view("<u8").astype(np.int64))
        at += w * n
    return out


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 4).compress(data, asbytes=True)


def _loose(data: bytes) -> bytes:
    return pa.Codec("zstd", 4).decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _by_model(rows: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """Each model of the rows with the places of its rows."""
    names = rows["model"].combine_chunks()
    names = names if pa.types.is_dictionary(names.type) else names.dictionary_encode()
    which = names.indices.to_numpy(zero_copy_only=False)
    for i, m in enumerate(names.dictionary.to_pylist()):
        yield m, np.flatnonzero(which == i)


PARTS = {"block": pa.int64(), "fold": pa.int64(), "models": pa.list_(pa.string()), "sizes": pa.list_(pa.int64()), "docs": pa.binary(), "uses": pa.binary(), "words": pa.binary()}


def _block(fold: int, ids: list, hashes: list, langs: list, texts: list) -> pa.RecordBatch:
    held: list[tuple[str, bytes]] = []
    models: dict = {}
    counts, every = [], [np.zeros(0, np.int64)]
    for lang, text in zip(langs, texts):
        t = text or ""
        words = t.encode("utf-8", "replace").split()
        if lang not in models:
            models[lang] = Words(model_of(lang), held)
        own = np.fromiter(map(models[lang].__getitem__, words), np.int64, len(words))
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        counts.append((len(words), len(t) - sum(map(t.count, SPACE)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(own)))
        every.append(own)
    places = np.concatenate(every)
    docs = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(hashes), pa.array(langs, pa.string()), *(pa.array(list(c), pa.int64()) for c in zip(*counts))], ["_id", "text_hash", "lang", *COUNTS])
    # words by model, the commonest first, then by name, which is what compresses best
    names = sorted({m for m, _ in held})
    number = {m: i for i, m in enumerate(names)}
    order = np.array(sorted(range(len(held)), key=lambda i: held[i][1]), np.int64)
    order = order[np.argsort(-np.bincount(places, minlength=len(held))[order], kind="stable")]
    of = np.array([number[m] for m, _ in held], np.int64)
    order = order[np.argsort(of[order], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    uses = len(places).to_bytes(8, "little") + pack(rank[places])
    words = _squeezed(b" ".join(held[i][1] for i in order))
    row = [uuid.uuid4().int >> 65, fold, names, np.bincount(of, minlength=len(names)).tolist(), _packed(docs), uses, words]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, PARTS.values())], list(PARTS))


class Block:
    """A block unpacked: its documents, their words as numbers in order, and the words, those of each model together."""

    def __init__(self, fold: int, models: list[str], sizes: list[int], docs: bytes, uses: bytes, words: bytes) -> None:
        self.fold, self.models = fold, models
        self.docs = pa.ipc.open_stream(docs).read_all()
        (self.seq,) = unpack(uses[8:], 1, int.from_bytes(uses[:8], "little"))
        self.words = _loose(words).split()
        ends = np.cumsum(sizes).tolist()
        #: (model, first word, end of its words)
        self.ranges = list(zip(models, [0, *ends], ends))

    @staticmethod
    def of(rows) -> Iterator[tuple[int, Block]]:
        """(block, Block) of each row of a batch or table of blocks()."""
        columns = [rows[c].to_pylist() for c in PARTS]
        for block, *rest in zip(*columns):
            yield block, Block(*rest)


def fold_of(words: list[bytes]) -> int:
    """0 or 1 by a min-hash of a text's words, of those over four bytes if there are any, so that near copies mostly agree."""
    some = set(words)
    some = [w for w in some if len(w) > 4] or some
    return (min(map(zlib.crc32, some)) * 0x9E3779B1 >> 13) & 1 if some else 0


class Waiting:
    """Rows of one fold that are not yet a block."""

    def __init__(self, fold: int) -> None:
        self.fold, self.size = fold, 0
        self.ids, self.hashes, self.langs, self.texts = [], [], [], []

    def add(self, b: pa.RecordBatch, lang: list, text: list, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = [text[i] for i in at]
        for i, j in chunks([t or "" for t in new], BLOCK // 8):
            more = sum(len(t or "") for t in new[i:j])
            if self.size and self.size + more > BLOCK:
                yield from self.rest()
            places = pa.array(at[i:j])
            self.ids.append(b["_id"].take(places))
            self.hashes.append(b["text_hash"].take(places))
            self.langs += [lang[k] for k in at[i:j]]
            self.texts += new[i:j]
            self.size += more

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            yield _block(self.fold, self.ids, self.hashes, self.langs, self.texts)
            self.__init__(self.fold)


def blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(block, fold, models, sizes, docs, uses, words): one row for about BLOCK bytes of text, packed; written once, so that a block's number stays its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [Waiting(0), Waiting(1)]
        for b in batches:
            text, lang = b["text"].to_pylist(), b["lang"].to_pylist()
            fold = np.array([fold_of((t or "").encode("utf-8", "replace").split()) for t in text], np.int64)
            for w in waiting:
                yield from w.add(b, lang, text, np.flatnonzero(fold == w.fold))
        for w in waiting:
            yield from w.rest()

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    made = rows.mapInArrow(run, "block long, fold long, models array<string>, sizes array<long>, docs binary, uses binary, words binary")
    return bucketed(made, "block", "ngram_blocks")


def key_bits(parts: DataFrame) -> int:
    """Bits of a hash for which about one in 500 bigrams at most shares its hash with another, however many words there are."""
    n = parts.agg(F.sum(F.octet_length("uses"))).first()[0] or 0
    return min(max(n.bit_length() + 8, 36), 60)


class Bigrams:
    """The distinct bigrams of a block in order of their hashes of `bits` bits, and where each word of its texts stands among them."""

    def __init__(self, block: Block, bits: int) -> None:
        self.block, self.words = block, max(len(block.words), 1)
        self.size = block.docs["n_words"].to_numpy()
        self.inside = np.ones(len(block.seq), bool)
        self.inside[(np.cumsum(self.size) - self.size)[self.size > 0]] = False
        second = block.seq[self.inside]
        first = block.seq[:-1][self.inside[1:]] if len(block.seq) else second
        key, self.place, n = np.unique(first * self.words + second, return_inverse=True, return_counts=True)
        first, second = key // self.words, key % self.words
        whole = np.zeros(self.words, np.uint64)
        for m, i, j in block.ranges:
            seed = xxhash.xxh64_intdigest(m.encode("utf-8", "replace"))
            whole[i:j] = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in block.words[i:j]), np.uint64, j - i)
        pair = whole[first] * np.uint64(0x9E3779B97F4A7C15) + (whole[second] ^ (whole[second] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)
        order = np.argsort(pair, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place = back[self.place]
        self.keys, self.first, self.second, self.n = pair[order].astype(np.int64), first[order], second[order], n[order].astype(np.int64)
        self.hash = (whole >> np.uint64(64 - bits)).astype(np.int64)


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted keys for each range that holds any."""
    ends = np.searchsorted(keys, np.arange(ranges + 1) * (1 << bits) // ranges)
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), int(ends[k]), int(ends[k + 1])


def bigram_counts(parts: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(block, same, n_same, other, n_other): of a block's bigrams, those that other blocks of its fold hold too, and those that the other fold holds.

    same: places, occurrences in the fold, and whether this block owns the bigram; other: places and occurrences.
    """
    kinds = {"range": pa.int64(), "block": pa.int64(), "fold": pa.int64(), "first": pa.int64(), "size": pa.int64(), "data": pa.binary()}

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, got in Block.of(b):
                own = Bigrams(got, bits)
                rows = [(k, block, got.fold, i, j - i, pack(np.diff(own.keys[i:j], prepend=0), own.n[i:j])) for k, i, j in _cuts(own.keys, ranges, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    def take(rows: pa.Table) -> pa.Table:
        size = rows["size"].to_numpy()
        got = [unpack(d, 2, n) for d, n in zip(rows["data"].to_pylist(), size)]
        n, fold = np.concatenate([g[1] for g in got]), np.repeat(rows["fold"].to_numpy(), size)
        _, at = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
        _, index, own, times = np.unique(2 * at + fold, return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(own, weights=n)[own].astype(np.int64)
        elsewhere = np.bincount(at, weights=n)[at].astype(np.int64) - total
        owner = np.zeros(len(at), np.int64)
        owner[index] = 1
        shared, out, start = times[own] > 1, [], 0
        for block, first, m in zip(rows["block"].to_pylist(), rows["first"].to_pylist(), size):
            same, other = np.flatnonzero(shared[start : start + m]), np.flatnonzero(elsewhere[start : start + m])
            if len(same) or len(other):
                out.append((block, pack(np.diff(same + first, prepend=0), total[same + start], owner[same + start]), len(same), pack(np.diff(other + first, prepend=0), elsewhere[other + start]), len(other)))
            start += m
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["block", "same", "n_same", "other", "n_other"])

    given = parts.mapInArrow(give, "range long, block long, fold long, first long, size long, data binary")
    return bucketed(given.groupBy("range").applyInArrow(take, "block long, same binary, n_same long, other binary, n_other long"), "block", "ngram_pairs")


def _counts_of(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3 and 4, and how many are not 0."""
    return [int((values == k).sum()) for k in (1, 2, 3, 4)] + [int((values > 0).sum())]


def word_sums(parts: DataFrame, pairs: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(block, model, data, size, stats): a block's words with their sums in the other fold; and without a block, a model's counts of counts.

    stats: how many bigrams occur once, twice, three and four times and at all, in either fold; then the
    same of words by how many different words come before them.
    """
    kinds = "range long, block long, fold long, model string, first long, data binary, size long, stats array<long>"
    names = [k.split()[0] for k in kinds.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, got in Block.of(left):
            own = Bigrams(got, bits)
            c, owned = own.n.copy(), np.ones(len(own.n), bool)
            for data, size in zip(right["same"].to_pylist(), right["n_same"].to_pylist()):
                at, total, mine = unpack(data, 3, size)
                at = np.cumsum(at)
                c[at], owned[at] = total, mine > 0
            first, second, c = own.first[owned], own.second[owned], c[owned]
            sums = [np.bincount(first, weights=x, minlength=own.words).astype(np.int64) for x in (c, c == 1, c == 2, c > 2)] + [np.bincount(second, minlength=own.words)]
            for m, i, j in got.ranges:
                stats = np.zeros(20, np.int64)
                stats[5 * got.fold : 5 * got.fold + 5] = _counts_of(c[(first >= i) & (first < j)])
                out.append((xxhash.xxh64_intdigest(m.encode("utf-8", "replace")) % ranges, None, None, m, None, None, None, stats.tolist()))
                at = i + np.argsort(own.hash[i:j], kind="stable")
                keys = own.hash[at]
                out += [(k, block, got.fold, m, f, pack(np.diff(keys[f:t], prepend=0), *(s[at[f:t]] for s in sums)), t - f, None) for k, f, t in _cuts(keys, ranges, bits)]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    def take(rows: pa.Table) -> pa.Table:
        stats: dict[str, np.ndarray] = {}
        for m, s in zip(rows["model"].to_pylist(), rows["stats"].to_pylist()):
            if s is not None:
                stats[m] = stats.get(m, 0) + np.array(s)
        rows, out = rows.filter(pc.is_valid(rows["data"])), []
        for m, at in _by_model(rows):
            mine = rows.take(pa.array(at))
            size = mine["size"].to_numpy()
            got = [unpack(d, 1 + SUMS, n) for d, n in zip(mine["data"].to_pylist(), size)]
            _, at = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
            fold = np.repeat(mine["fold"].to_numpy(), size)
            columns = [np.concatenate([g[1 + k] for g in got]) for k in range(SUMS)]
            sums = [[np.bincount(at, weights=np.where(fold == f, c, 0)).astype(np.int64) for c in columns] for f in (0, 1)]
            stats[m] = stats.get(m, 0) + np.array([0] * 10 + _counts_of(sums[0][-1]) + _counts_of(sums[1][-1]))
            start = 0
            for block, f, first, n in zip(mine["block"].to_pylist(), mine["fold"].to_pylist(), mine["first"].to_pylist(), size):
                other = [s[at[start : start + n]] for s in sums[1 - f]]
                found = np.flatnonzero((other[0] > 0) | (other[-1] > 0))
                if len(found):
                    out.append((block, m, pack(np.diff(found + first, prepend=0), *(x[found] for x in other)), len(found), None))
                start += n
        out += [(None, m, None, None, s.tolist()) for m, s in stats.items()]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], names=["block", "model", "data", "size", "stats"])

    given = parts.groupBy("block").cogroup(pairs.select("block", "same", "n_same").groupBy("block")).applyInArrow(give, kinds)
    return bucketed(given.groupBy("range").applyInArrow(take, "block long, model string, data binary, size long, stats array<long>"), "block", "ngram_words")


def block_grams(parts: DataFrame) -> DataFrame:
    """(block, fold, model, gram, n): the n-grams of characters of each block, each once for a model, with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, got in Block.of(b):
                n = np.bincount(got.seq, minlength=len(got.words))
                for m, i, j in got.ranges:
                    parts = []
                    for f in range(i, j, SPELLED):
                        owner, h = grams(got.words[f : min(f + SPELLED, j)])
                        u, where = np.unique(h, return_inverse=True)
                        parts.append((u, np.bincount(where, weights=n[f + owner], minlength=len(u))))
                    u, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    total = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)
                    for f in range(0, len(u), 1 << 16):
                        g = u[f : f + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(np.full(len(g), got.fold)), pa.repeat(m, len(g)), pa.array(g), pa.array(total[f : f + (1 << 16)])], ["block", "fold", "model", "gram", "n"])

    # the n-grams of a block are few against its words, and both the counts and the answers come from them
    return checkpointed(parts.mapInArrow(run, "block long, fold long, model string, gram long, n long"))


def _longer(k: int) -> Column:
    return F.col("gram") >= F.lit(1 << BITS * k)


def counts_by_order(found: DataFrame) -> DataFrame:
    """(model, k, gram, n0, n1) for k from ORDER to 1, out of (model, gram, n0, n1) of the longest n-grams.

    The longest n-grams and those at a word's begin count by occurrences in each fold, shorter ones
    by how many different characters come before them. A count may be 0 in one of the folds.
    """
    above = found.where(_longer(ORDER - 1))
    out = above.select("model", F.lit(ORDER).alias("k"), "gram", "n0", "n1")
    for k in range(ORDER - 1, 0, -1):
        inner = above.groupBy("model", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")).agg(*(F.count_if(F.col(n) > 0).alias(n) for n in ("n0", "n1")))
        above = inner.unionByName(found.where(_longer(k - 1) & ~_longer(k))) if k > 1 else inner
        out = out.unionByName(above.select("model", F.lit(k).alias("k"), "gram", "n0", "n1"))
    return out


def _discount_columns(n: str) -> list[Column]:
    """The discounts of one fold as columns, out of its counts of counts."""
    n1, n2, n3, n4 = (F.greatest(F.col(f"{n}_{j}"), F.lit(1)).cast("double") for j in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [F.greatest(F.lit(0.1), F.least(F.lit(most), d)).alias(f"{n}_d{j}") for j, d, most in zip((1, 2, 3), raw, (0.9, 1.9, 2.9))]


def log_probabilities(found: DataFrame) -> DataFrame:
    """(model, gram, p0, p1): log probabilities of the characters by the model of each fold, for each n-gram of found (model, gram, n0, n1)."""
    counts = checkpointed(counts_by_order(found))
    folds = ("n0", "n1")
    of = counts.groupBy("model", "k").agg(F.count("*").alias("kinds"), *(F.count_if(F.col(n) == j).alias(f"{n}_{j}") for n in folds for j in (1, 2, 3, 4)))
    of = of.select("model", "k", "kinds", *(d for n in folds for d in _discount_columns(n)))
    counts = counts.join(of, ["model", "k"])
    lower, out = None, None
    for k in range(1, ORDER + 1):
        context = Window.partitionBy("model", F.shiftright("gram", BITS))
        columns = []
        for n in folds:
            cut = F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, F.col(f"{n}_d1")).when(F.col(n) == 2, F.col(f"{n}_d2")).otherwise(F.col(f"{n}_d3"))
            total = F.sum(n).over(context)
            columns += [F.when(total > 0, (F.col(n) - cut) / total).otherwise(0.0).alias(f"own_{n}"), F.when(total > 0, F.sum(cut).over(context) / total).otherwise(1.0).alias(f"rest_{n}")]
        rows = counts.where(F.col("k") == k).select("model", "gram", (1 / F.col("kinds")).alias("even"), *columns)
        if lower is not None:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(lower, ["model", "suffix"])
        rows = rows.select("model", "gram", *((F.col(f"own_{n}") + F.col(f"rest_{n}") * F.col("even" if lower is None else f"below_{n}")).alias(n) for n in folds))
        lower = rows.select("model", F.col("gram").alias("suffix"), *(F.col(n).alias(f"below_{n}") for n in folds))
        # a shorter n-gram is looked up only where it begins a word
        used = rows if k == ORDER else rows.where(F.shiftright("gram", BITS * (k - 1)) == BEGIN)
        out = used if out is None else out.unionByName(used)
    return out.select("model", "gram", F.log("n0").cast("float").alias("p0"), F.log("n1").cast("float").alias("p1"))


def word_probabilities(own: Bigrams, pairs: list[dict], words: list[dict], rows: pa.Table) -> np.ndarray:
    """Log probability of each word of the block's texts, in order, by the model of the other fold.

    pairs: rows of bigram_counts; words: rows of word_sums; rows: log probabilities of n-grams of characters, and stats of models.
    """
    block, w = own.block, own.words
    c = np.zeros(len(own.keys))
    for p in pairs:
        at, n = unpack(p["other"], 2, p["n_other"])
        c[np.cumsum(at)] = n
    letters = rows.filter(pc.is_valid(rows["gram"]))
    gram, value, of_model = letters["gram"].to_numpy(), letters["log_p"].to_numpy(), dict(_by_model(letters))
    sums, cut, single = np.zeros((SUMS, w)), np.zeros((3, w)), np.zeros(w)
    rest = rows.filter(pc.is_valid(rows["stats"]))
    stats = {m: np.array(v, float) for m, v in zip(rest["model"].to_pylist(), rest["stats"].to_pylist())}
    for m, i, j in block.ranges:
        slots = of_model[m][np.argsort(gram[of_model[m]])]
        known, p, spelled = gram[slots], value[slots], np.zeros(j - i)
        for f in range(0, j - i, SPELLED):
            part = block.words[i + f : min(i + f + SPELLED, j)]
            owner, h = grams(part)
            spelled[f : f + len(part)] = np.exp(np.bincount(owner, weights=p[np.searchsorted(known, h)], minlength=len(part)))
        order = i + np.argsort(own.hash[i:j], kind="stable")
        for x in words:
            if x["model"] != m:
                continue
            place, *found = unpack(x["data"], 1 + SUMS, x["size"])
            for k in range(SUMS):
                sums[k][order[np.cumsum(place)]] = found[k]
        two, one = stats[m].reshape(2, 2, 5)[:, 1 - block.fold]
        cut[:, i:j] = np.array(discounts(*two[:4]))[:, None]
        # words before a word, out of all distinct bigrams, with what is cut off given to the spelling
        d = discounts(*one[:4])
        before = sums[SUMS - 1][i:j]
        rest = (d[0] * one[0] + d[1] * one[1] + d[2] * (one[4] - one[0] - one[1])) / two[4] if two[4] else 1.0
        off = np.select([before == 0, before == 1, before == 2], [0.0, d[0], d[1]], d[2])
        single[i:j] = (before - off) / max(two[4], 1) + rest * spelled
    total, f1, f2, f3 = sums[:4]
    rest = np.where(total > 0, (cut[0] * f1 + cut[1] * f2 + cut[2] * f3) / np.maximum(total, 1), 1.0)
    a, b = own.first, own.second
    off = np.select([c == 0, c == 1, c == 2], [0.0, cut[0][a], cut[1][a]], cut[2][a])
    pair = (c - off) / np.maximum(total[a], 1) + rest[a] * single[b]
    p = single[block.seq]
    p[own.inside] = pair[own.place]
    return np.log(np.maximum(p, 1e-300))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text_hash, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity) of each row.

    log_perplexity is the mean of -log p over the words of the text, null without a word. Other
    columns of docs are not read.
    """
    parts = blocks(docs, id_col, text_col, lang_col)
    ranges = max(RANGES, (parts.agg(F.sum(F.octet_length("uses"))).first()[0] or 0) // RANGE)
    bits = key_bits(parts)
    pairs = bigram_counts(parts, ranges, bits)
    sums = word_sums(parts, pairs, ranges, bits)
    wanted = block_grams(parts)
    letters = log_probabilities(checkpointed(wanted.groupBy("model", "gram").agg(*(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)))))
    spelled = wanted.select("block", "fold", "model", "gram").join(letters, ["model", "gram"])
    known = sums.where("block is null").groupBy("model").agg(F.array(*(F.sum(F.col("stats")[i]) for i in range(20))).alias("stats"))
    models = parts.select("block", F.explode("models").alias("model")).join(known, "model")
    answers = spelled.select("block", "model", "gram", F.when(F.col("fold") == 0, F.col("p1")).otherwise(F.col("p0")).alias("log_p"), F.lit(None).cast("array<long>").alias("stats"))
    answers = answers.unionByName(models.select("block", "model", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("float").alias("log_p"), "stats"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, text_hash long, lang string, {', '.join(f'{c} long' for c in COUNTS)}, log_perplexity double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for (_, got), pairs, words in zip(Block.of(left), left["pairs"].to_pylist(), left["sums"].to_pylist()):
            own = Bigrams(got, bits)
            doc = np.repeat(np.arange(len(got.docs)), own.size)
            total = np.bincount(doc, weights=word_probabilities(own, pairs or [], words or [], right), minlength=len(got.docs)) if len(got.seq) else np.zeros(len(got.docs))
            out.append(got.docs.append_column("log_perplexity", pa.array(-total / np.maximum(own.size, 1), mask=own.size == 0)))
        return pa.concat_tables(out) if out else pa.schema([("_id", pa.null()), ("text_hash", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in COUNTS), ("log_perplexity", pa.float64())]).empty_table()

    # these tables are dealt by block, so only the answers move
    held = pairs.groupBy("block").agg(F.collect_list(F.struct("other", "n_other")).alias("pairs"))
    of_words = sums.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("model", "data", "size")).alias("sums"))
    return parts.join(held, "block", "left").join(of_words, "block", "left").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("_id", "doc_id")


def judged(docs: DataFrame, below: float = BELOW, above: float = ABOVE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, log_perplexity, the language's band and kept, for each row of docs.

    The model is counted on all texts; a language's band is set around the median of the texts that
    pass the base rules, each text once however many copies it has. Its width is the distance from the
    median to the nearer quartile, so junk on one side can't widen it. A null language is a language
    of its own. Texts that are null, empty or blank have no words, fail the base rules and
    have no perplexity. Repeated rows stay; an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = checkpointed(scored(docs, id_col, text_col, lang_col).withColumn("base_failed", failed))
    good = rows.where("not base_failed").dropDuplicates(["lang", "text_hash"])
    score = F.col("log_perplexity")
    quarters = F.percentile_approx(score, [0.25, 0.5, 0.75], 10000)
    spread = good.groupBy(F.col("lang").alias("_lang")).agg(quarters.alias("q")).select("_lang", F.col("q")[1].alias("middle"), F.greatest(F.least(F.col("q")[1] - F.col("q")[0], F.col("q")[2] - F.col("q")[1]), F.lit(0.01)).alias("spread"))
    bands = spread.select("_lang", (F.col("middle") - below * F.col("spread")).alias("lower"), (F.col("middle") + above * F.col("spread")).alias("upper"))
    inside = F.coalesce(score.between(F.col("lower"), F.col("upper")), F.lit(False))
    return rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("kept", ~F.col("base_failed") & inside).drop("_lang")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity", "lower", "upper")
