"""Brute force, round trips and odd rows for the training-data operators."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from loomrail.llm import byte_bpe, catalog, chat_format, html_text, language_id, mixing, perplexity, simhash, suffix_dedup, suffix_sort, topk_search, toxic_spans

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", None), (4, "ok " * 40, "en", "a"), (4, "ok " * 40, "en", "a"), (None, "é漢🙂 x", None, "b"), (6, "w" * 70000, "de", "b"), (7, "ok " * 40, "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    names = {c: F.lit(i) for i, c in enumerate(["k", "h", "key", "fp", "label", "size", "hash", "pos", "at"])}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(names).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_fingerprints_and_components(spark, documents):
    rows = catalog.queries()["op9_simhash_near_dedup"](spark, SF).toPandas()
    assert len(rows) == len(documents)
    texts = dict(zip(documents.doc_id, documents.text))
    for r in rows.head(40).itertuples():
        w = texts[r.doc_id].encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert r.fingerprint == f"{want:016x}"
    x = np.array([int(f, 16) for f in rows.fingerprint], np.uint64)
    label = rows.doc_id.to_numpy()
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (label == rows.component_id.to_numpy()).all()


def test_large_buckets_keep_their_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, np.uint64)
    fps = np.unique(np.concatenate([base[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 30, (900, 2)).astype(np.uint64), axis=1) for k in range(6)]))
    old, simhash.MATRIX = simhash.MATRIX, 64
    try:
        u, v = simhash._stars(fps, 3, (1 << 64) - 1)
    finally:
        simhash.MATRIX = old
    a, b = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3), {f: f for f in fps.tolist()}

    def root(z):
        while b[z] != z:
            z = b[z]
        return z

    for p, q in zip(u.tolist(), v.tolist()):
        b[root(p)] = root(q)
    label = np.arange(len(fps))
    while True:
        new = np.where(a, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    roots = np.array([root(z) for z in fps.tolist()], np.uint64)
    assert len(set(label.tolist())) == len(set(roots.tolist()))


def removed(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i : i + 200] = True
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        yield len(t), int(cover.sum()), runs, hashlib.sha256(bytes(x for x, c in zip(t, cover) if not c)).hexdigest()


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_repeated_strings(spark, documents, hot):
    old, suffix_dedup.HOT = suffix_dedup.HOT, hot
    try:
        rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in catalog.queries()["op5_suffix_dedup"](spark, SF).collect()}
    finally:
        suffix_dedup.HOT = old
    want = dict(zip(documents.doc_id, removed([t.encode() for t in documents.text])))
    assert rows == want


def test_deep_shallow_order():
    rng = np.random.default_rng(5)
    values = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) * rng.integers(1, 4) for _ in range(400)] + [b"a" * 90 + bytes([x]) for x in b"cabab"]
    rows = suffix_sort.deep_shallow.__globals__["np"].frombuffer(b"".join(v[:200].ljust(200, b"\0") for v in values), np.uint8).reshape(len(values), 200)
    length = np.array([min(len(v), 200) for v in values])
    order = suffix_sort.deep_shallow(rows, length, np.zeros(len(values), np.int64), 16)
    assert [values[i][:200] for i in order] == sorted(v[:200] for v in values)


def test_bpe_is_tiktoken(spark, documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.load_ranks(path)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    encoder = byte_bpe.Encoder(byte_bpe.Merges(tokens), public_tokenizers.PATTERN)
    for text in ["", " ", "it's  he'LL\x1c x y", "漢字🙂é" * 50, "a" * 3000, " " * 999 + "x", "\n\n a\t", "2²½ ①"]:
        assert np.concatenate([*encoder(text), np.zeros(0, int)]).tolist() == other.encode_ordinary(text) == next(iter(encoder.many([text]))).tolist()
    rows = {r["doc_id"]: r for r in catalog.queries()["op6_byte_bpe"](spark, SF).collect()}
    for i, text in zip(documents.doc_id, documents.text):
        ids = other.encode_ordinary(text)
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    names = sorted(theirs.columns)
    # a null among numbers is NaN for one engine, and makes the others doubles
    value = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    plain = lambda frame: sorted(str([value(v) for v in row]) for row in frame[names].astype(object).values.tolist())
    assert plain(ours) == plain(theirs)


def test_languages_of_held_out_rows(spark, documents):
    rows = catalog.queries()["op10_language_id"](spark, SF).toPandas().merge(documents, on="doc_id")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.95


def test_copies_take_no_place_in_the_language_sample(spark):
    rng = np.random.default_rng(9)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(20))
    rows = [(text("abcde"), "xx") for _ in range(80)] + [(text("abcfg"), "yy") for _ in range(80)] + [("zzz", "xx")] * 20000 + [("only one ñ", "zz")]
    docs = spark.createDataFrame([(4 * i + k, *r) for i, r in enumerate(rows) for k in (0, 1)], "doc_id long, text string, lang string")
    got = language_id.identified(docs.where("text <> 'zzz'"), language_id.fit(docs, sample=40), keep=("lang",)).toPandas()
    assert set(got.lang) == {"xx", "yy", "zz"} and (got.lang == got.lang_pred).groupby(got.lang).mean().min() > 0.9


def test_toxic_scores_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = catalog.queries()["op4_toxic_spans"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    bad, rank = held.toxic == 1, held.score.rank()
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    right = (held.predicted == 1) & bad
    assert auc > 0.94 and right.sum() / bad.sum() > 0.85 and right.sum() / held.predicted.sum() > 0.85
    assert (held[bad].spans.str.len() > 0).mean() > 0.85 and (held[~bad].spans.str.len() > 0).mean() < 0.05
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_query_scores_by_the_definition(spark, documents):
    """The query's scores against a plain recursion in logarithms, a text at a time, with the same model."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocabulary, weights, trans, bias, last = toxic_spans.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in catalog.queries()["op4_toxic_spans"](spark, SF).collect()}
    for i, text in zip(documents.doc_id, documents.text):
        names = [[vocabulary.get(n, 0) for n in toxic_spans.names_of(toxic_spans.normal(w))] for w in text.encode().split()]
        e = [bias + sum(weights[k, x] for k, x in zip((0, 3, 4, 5), ids)) + (weights[1, names[t - 1][0]] if t else 0) + (weights[2, names[t + 1][0]] if t + 1 < len(names) else 0) for t, ids in enumerate(names)]
        forward = []
        for t, x in enumerate(e):
            before = forward[-1] if t else None
            forward.append([np.logaddexp(before[0] + trans[0, s], before[1] + trans[1, s]) + s * x if t else s * x for s in (0, 1)])
        back, p = [0.0, 0.0], []
        for t in reversed(range(len(e))):
            f = [forward[t][s] + back[s] for s in (0, 1)]
            p.append(np.exp(f[1] - np.logaddexp(*f)))
            back = [np.logaddexp(trans[s, 0] + back[0], trans[s, 1] + e[t] + back[1]) for s in (0, 1)]
        x = toxic_spans.features(np.array(p))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(x @ last[:2] + last[2]))), rel=1e-6)


def test_copies_make_no_ordinary_word_toxic():
    rng = np.random.default_rng(6)
    body = lambda: b" ".join(b"w%d" % k for k in rng.integers(0, 300, 12))
    bad, clean = [b"the vile " + body() for _ in range(200)], [b"the " + body() for _ in range(1000)]
    texts = bad + clean + [clean[0]] * 1000
    toxic = np.arange(len(texts)) < len(bad)
    field = toxic_spans.train_field(texts, toxic)
    p = np.array([x[:2] for x in toxic_spans.marginals(field, bad[:50])])
    assert (p[:, 0] < 0.5).all() and (p[:, 1] > 0.5).all()


def test_copies_take_no_place_in_the_toxic_sample(spark):
    rng = np.random.default_rng(6)
    body = lambda: " ".join(f"w{k}" for k in rng.integers(0, 300, 12))
    texts = ["vile " + body() for _ in range(200)] + [body() for _ in range(200)] + ["the same"] * 6000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(len(texts))], "doc_id long, toxic int")
    rows = toxic_spans.tagged(docs, toxic_spans.fit(docs, labels, 50)).where("doc_id < 400").toPandas()
    assert (rows[rows.doc_id < 200].score > 0.5).mean() > 0.9 and (rows[rows.doc_id >= 200].score < 0.5).mean() > 0.9


def test_field_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(1)
    e, trans = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    f, b = toxic_spans.odds(e, np.ones((1, 6), bool), trans)
    weights = {}
    for path in np.ndindex(*(2,) * 6):
        weights[path] = np.exp(sum(e[0, t] * s for t, s in enumerate(path)) + sum(trans[i, j] for i, j in zip(path, path[1:])))
    want = [sum(w for p, w in weights.items() if p[t]) / sum(weights.values()) for t in range(6)]
    assert np.allclose(toxic_spans.sigmoid(f + b)[0], want)


def test_odd_rows(spark, odd):
    assert len(simhash.simhash_components(odd).collect()) == len(ODD)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({c["component_id"] for c in simhash.simhash_components(odd).collect()})
    cut = suffix_dedup.deduplicated(odd).collect()
    assert len(cut) == len(ODD) and suffix_dedup.without_repeats(odd).columns == odd.columns
    assert byte_bpe.digest_documents(odd).count() == len(ODD)
    mix = mixing.mixed(odd).collect()
    assert len(mix) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in mix)
    assert mixing.mixture(odd).columns == odd.columns
    model = language_id.fit(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identified(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und"
    assert language_id.in_known_language(odd).columns == odd.columns
    base = {r["doc_id"]: r for r in perplexity.judged(odd).collect()}
    assert len(base) == 7 and base[1]["base_failed"] and base[2]["log_perplexity"] is None
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxic_spans.tagged(odd, toxic_spans.fit(odd, labels)).count() == len(ODD)


def test_empty_tables(spark, odd):
    none = odd.where("false")
    for rows in (simhash.simhash_components(none), simhash.keep_one(none), suffix_dedup.without_repeats(none), byte_bpe.digest_documents(none), mixing.mixed(none), mixing.mixture(none), language_id.in_known_language(none), perplexity.judged(none)):
        assert rows.count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxic_spans.tagged(none, toxic_spans.fit(none, labels)).count() == 0
    vectors = topk_search.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk_search.top_matches(vectors, vectors).count() == 0


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s", 7), (1, 1, "ann", "hi <|end|> <\\|", 7), (1, 2, "bob", None, 7), (1, None, None, "x", 7), (1, 5, "unknown", "y", 7), (None, 1, "a|>\n", "y", 7), (2, 0, "system", "z", 7)], "conv_id long, turn long, role string, text string, segment int")
    got = chat_format.perspectives(rows).collect()
    assert Counter(r["speaker"] for r in got) == {"ann": 5, "bob": 5, "unknown": 5, None: 5, "a|>\n": 1}
    whole = {r["speaker"]: r for r in chat_format.renderings(rows).where("conv_id = 1").collect()}
    said = "<|system|>\ns<|end|>\n<|user name=ann|>\nhi <\\|end|> <\\\\|<|end|>\n{}<|end|>\n<|user name=unknown|>\ny<|end|>\n{}x<|end|>\n"
    assert whole["bob"]["rendering"] == said.format("<|assistant|>\n", "<|user|>\n")
    assert whole[None]["rendering"] == said.format("<|user name=bob|>\n", "<|assistant|>\n")
    for who, learned in (("bob", "<|end|>\n"), (None, "x<|end|>\n"), ("ann", "hi <\\|end|> <\\\\|<|end|>\n")):
        assert [whole[who]["rendering"][m["start_at"] : m["end_at"]] for m in whole[who]["masks"]] == [learned]
    odd = rows.where("conv_id is null").withColumns({"role": F.lit("b"), "conv_id": F.lit(3)}).union(rows.where("conv_id is null").withColumn("conv_id", F.lit(3)))
    assert {r["segment"] for r in chat_format.perspectives(odd).where("as_role = 'user'").collect()} == {"<|user name=b|>\ny<|end|>\n", "<|user name=a\\b>\\n|>\ny<|end|>\n"}
    assert chat_format.perspectives(rows.where("false")).count() == chat_format.renderings(rows.where("false")).count() == 0


def test_long_conversations_and_repeated_messages(spark):
    rows = [(1, t, ("ann", "bob")[t % 2], f"m{t % 7}") for t in range(2500)] + [(1, None, "ann", "same")] * 300 + [(1, 9, "bob", f"n{k}") for k in range(300)]
    got = chat_format.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for who in ("ann", "bob"):
        own = sorted((r for r in got if r["speaker"] == who), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(1, len(rows) + 1))
        assert [r["start_at"] for r in own] == [0, *np.cumsum([len(r["segment"]) for r in own])[:-1].tolist()]
        assert sorted(Counter(r["segment"] for r in own).values())[-1] >= 300
        turns = [r["turn"] for r in own]
        assert turns == sorted(turns, key=lambda t: (t is None, t))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose other columns have the names of helper columns."""
    text = "".join(f"ä{k} " for k in range(90))
    rows = [(1, "é" * 3 + text + "漢", "en", "a"), (2, "ç" * 3 + text + "�x 漠", "en", "a"), (3, "kurz", "de", None), (None, None, None, "b")]
    names = ["_k", "_rest", "_spans", "_whole", "_new", "_id", "_hash", "_text_hash", "_source", "_copies", "_copy", "_text", "label", "h", "key", "fp"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(names)})


@pytest.mark.parametrize("stage", [simhash.keep_one, suffix_dedup.without_repeats, mixing.mixture, language_id.in_known_language])
def test_clashing_columns_pass_through(spark, clashing, stage):
    rows = stage(clashing).collect()
    assert stage(clashing).columns == clashing.columns and rows
    assert {tuple(r)[4:] for r in rows} == {tuple(range(len(clashing.columns) - 4))}


def test_cuts_take_broken_characters_only(spark, clashing):
    rows = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(clashing).collect()}
    # 漢 and 漠 share their first two bytes, é and ç their first; the U+FFFD of the text stays
    assert rows == {1: "é" * 3 + "漢", 2: "ç" * 3 + "�x 漠", 3: "kurz", None: None}
