"""The pipeline stage by stage against plain code."""

from collections import Counter

import duckdb
import hashlib
import numpy as np
import tiktoken

import corpus_pipeline
import public_tokenizers
from loomrail.llm import byte_bpe, language_id, mixing, simhash

SF = "/root/testdata/sf0.001"


def classes(texts):
    """The smallest id of each text's component of links of three bits or fewer."""
    ids = sorted(texts)
    fp = np.array([simhash.fingerprint((texts[i] or "").encode()) for i in ids], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def cut(texts):
    """Each text without the 200-byte strings that stand elsewhere too, and without characters that a cut breaks."""
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(t[k : k + 200] for t in data.values() for k in range(len(t) - 199))
    for i, t in data.items():
        cover = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                cover[k : k + 200] = True
        edges = np.flatnonzero(np.diff(np.r_[True, cover[:-1], True].astype(int)))
        # pieces that stay begin where the cover ends and end where it begins
        pieces = [t[a:b] for a, b in zip(edges[::2], edges[1::2])]
        yield i, texts[i] if not cover.any() else "".join(p.decode("utf-8", "ignore") for p in pieces)


def test_every_stage_and_the_last_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    model = language_id.fit(docs)
    guess = {i: model.predict(t) for i, t in first.items()}
    want = {i: t for i, t in first.items() if guess[i][0] != "und" and guess[i][1] >= 0.4}
    assert {r["doc_id"]: r["text"] for r in known.collect()} == want
    single = stages["simhash_near_dedup"](spark, known, SF)
    want = {i: want[i] for i in set(classes(want).values())}
    assert {r["doc_id"]: r["text"] for r in single.collect()} == want
    rest = stages["suffix_array_dedup"](spark, single, SF).checkpoint()
    want = {i: t for i, t in cut(want) if t}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rest.collect()} == {i: (t, len(t)) for i, t in want.items()}
    taken = stages["source_mix"](spark, rest, SF)
    con = duckdb.connect()
    con.register("documents", rest.toPandas())
    copies = {i: n for i, n in con.execute(f"SELECT doc_id, CASE WHEN size > 0 THEN taken // size END FROM ({mixing.OP2_SQL})").fetchall()}
    counted = Counter(r["doc_id"] for r in taken.collect())
    assert all(counted[i] == n for i, n in copies.items() if n is not None)
    ranks = {t: i for i, t in enumerate(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert last == Counter({(i, len(encoding.encode_ordinary(want[i])), hashlib.sha256(want[i].encode()).hexdigest()): n for i, n in counted.items()})
