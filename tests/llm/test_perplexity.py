"""The word model and the base rules by brute force, and junk on both sides of the bands."""

from collections import Counter

import numpy as np
import pytest

from loomrail.llm import catalog, perplexity

SF = "/root/testdata/sf0.001"


def test_base_rules(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    rows = catalog.queries()["op1_ngram_perplexity"](spark, SF).toPandas().set_index("doc_id")
    assert len(rows) == len(documents)
    space = " \t\n\x0b\x0c\r"
    for i, t in zip(documents.doc_id, documents.text):
        w = t.encode().split()
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines, twice = set(), 0
        for line in t.split("\n"):
            if any(x not in space for x in line):
                twice += line in lines
                lines.add(line)
        want = (len(w), sum(x not in space for x in t), sum(x in "#*$%&|<>" for x in t), twice, len(cover))
        assert tuple(rows.loc[i, list(perplexity.COUNTS)].astype(int)) == (want[0], *want[1:])
        assert rows.base_failed[i] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert not rows[rows.base_failed].kept.any() and rows[~rows.base_failed].kept.mean() > 0.9


def cut(counts, n):
    d = [0, *perplexity.discounts(*(sum(m == j for m in counts) for j in (1, 2, 3, 4)))]
    return d[min(n, 3)]


def spelling(words, support):
    """p of each word of support by its characters, order 3, from words with counts; all n-grams of support are known kinds."""
    def raw(ws):
        out = Counter()
        for w, n in ws.items():
            t = "^" + w + "$"
            for i in range(1, len(t)):
                out[t[max(0, i - 2) : i + 1]] += n
        return out

    seen, kinds = raw(words), raw({w: 1 for w in [*words, *support]})
    counts = {3: {g: seen[g] for g in kinds if len(g) == 3}}
    for k in (2, 1):
        counts[k] = {g: sum(n > 0 for h, n in counts[k + 1].items() if h[1:] == g) for g in {h[1:] for h in counts[k + 1]}} | {g: seen[g] for g in kinds if len(g) == k}
    p = {"": 1 / len(counts[1])}
    for k in (1, 2, 3):
        every = list(counts[k].values())
        for g, n in counts[k].items():
            same = [m for h, m in counts[k].items() if h[:-1] == g[:-1]]
            total = sum(same)
            p[g] = ((n - cut(every, n)) / total if total else 0) + (sum(cut(every, m) for m in same) / total if total else 1) * p[g[1:]]
    return {w: np.prod([p[("^" + w + "$")[max(0, i - 2) : i + 1]] for i in range(1, len(w) + 2)]) for w in support}


def word_model(train, text):
    """log p of each word of text: bigrams, words before a word, spelling; from the definition."""
    pairs = Counter(p for t in train for p in zip(t, t[1:]))
    before = Counter(b for _, b in pairs)
    spelled = spelling(Counter(w for t in train for w in t), set(text))
    total, out = Counter(), []
    for (a, _), n in pairs.items():
        total[a] += n
    for k, w in enumerate(text):
        rest = sum(cut(before.values(), n) for n in before.values()) / len(pairs) if pairs else 1
        p = (before[w] - cut(before.values(), before[w])) / max(len(pairs), 1) + rest * spelled[w]
        if k and total[text[k - 1]]:
            a = text[k - 1]
            follow = [n for (x, _), n in pairs.items() if x == a]
            p = (pairs[a, w] - cut(pairs.values(), pairs[a, w])) / total[a] + sum(cut(pairs.values(), n) for n in follow) / total[a] * p
        out.append(np.log(p))
    return out


@pytest.mark.parametrize("size", [perplexity.BLOCK, 300])
def test_perplexity_is_kneser_ney(spark, size, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK", size)
    rng = np.random.default_rng(8)
    # a third of the words are common, so that the folds share bigrams; one letter is beyond the basic plane
    common = ["ab", "ca", "éa", "b", "abc"]
    word = lambda: str(rng.choice(common)) if rng.random() < 0.6 else "".join(rng.choice(list("abcé𐌰"), rng.integers(1, 8)))
    texts = [[word() for _ in range(int(rng.integers(1, 30)))] for _ in range(40)]
    langs = ["en" if i % 3 else None for i in range(len(texts))]
    rows = [(i, " ".join(t), l) for i, (t, l) in enumerate(zip(texts, langs))]
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    folds = [perplexity.fold_of([w.encode() for w in t]) for t in texts]
    assert len(got) == len(texts) and 8 < sum(folds) < 32
    kinds = {}
    for lang in ("en", None):
        for f in (0, 1):
            mine = [i for i in range(len(texts)) if langs[i] == lang and folds[i] == f]
            train = [texts[i] for i in range(len(texts)) if langs[i] == lang and folds[i] != f]
            # the kinds of n-grams are those of both folds
            kinds[lang] = {w for i in range(len(texts)) if langs[i] == lang for w in texts[i]}
            for i in mine:
                spelled = spelling(Counter(w for t in train for w in t), kinds[lang])
                want = word_model_with(train, texts[i], spelled)
                assert got[i] == pytest.approx(-np.mean(want), rel=1e-5)


def word_model_with(train, text, spelled):
    original = globals()["spelling"]
    globals()["spelling"] = lambda *_: spelled
    try:
        return word_model(train, text)
    finally:
        globals()["spelling"] = original


def test_probabilities_sum_to_one():
    train = [list("abcab"), list("bca")]
    words = ["a", "b", "c"]
    # with a spelling that gives these three words all the mass, so does the model after each of them
    even = {w: 1 / 3 for w in words}
    for before in words:
        assert sum(np.exp(word_model_with(train, [before, w], even)[1]) for w in words) == pytest.approx(1)


def test_near_copies_share_a_fold():
    rng = np.random.default_rng(1)
    # every text has the same common words, which must not decide
    texts = [[b"the" if rng.random() < 0.3 else f"w{k}".encode() for k in rng.integers(1000, 5000, 150)] for _ in range(400)]
    near = [[b"new" if i in (20, 70, 110) else w for i, w in enumerate(t)] for t in texts]
    folds = [perplexity.fold_of(t) for t in texts]
    assert 140 < sum(folds) < 260
    assert np.mean([f == perplexity.fold_of(n) for f, n in zip(folds, near)]) > 0.95


def test_bands_reject_junk_on_both_sides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    texts = [r["text"] for r in docs.collect()]
    rng = np.random.default_rng(4)
    common = [w for w, _ in Counter(w for t in texts for w in t.split()).most_common(14)]
    letters = [" ".join("".join(rng.choice(list("qzxjkvwpbgf"), rng.integers(2, 9))) for _ in range(80)) for _ in range(len(texts) // 4)]
    plain = [" ".join(rng.choice(common, 80)) for _ in range(len(texts) // 20)]
    copies = [" ".join(f"zq{k}xv{k * k}" for k in range(70))] * (len(texts) // 2)
    junk = spark.createDataFrame([(10**6 * k + i, t, "en") for k, group in enumerate((letters, plain, copies), 1) for i, t in enumerate(group)], docs.schema)
    rows = perplexity.judged(docs.union(junk)).where("not base_failed").toPandas()
    # the corpus has junk of its own: words with signs stuck to them
    signs = rows.n_symbols > 0.2 * rows.n_words
    group = (rows.doc_id // 10**6).where(~(signs & (rows.doc_id < 10**6)), -1)
    kept = rows.kept.groupby(group).mean()
    assert kept[0] > 0.97 and kept[-1] < 0.5 and kept[1] == kept[2] == kept[3] == 0
    side = np.sign(rows.log_perplexity - rows.upper).groupby(rows.doc_id // 10**6).mean()
    assert side[1] == side[3] == 1 and side[2] == -1


def chain(rng, following):
    w = [int(rng.integers(len(following)))]
    for _ in range(119):
        w.append(int(rng.choice(following[w[-1]])))
    return [f"k{x}" for x in w]


def test_shuffled_words_are_rejected(spark):
    rng = np.random.default_rng(3)
    following = rng.integers(0, 100, (100, 4))
    texts = [chain(rng, following) for _ in range(200)] + [list(rng.permutation(chain(rng, following))) for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t), "zz") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = perplexity.judged(docs).toPandas().set_index("doc_id").sort_index()
    assert not rows.base_failed.any() and rows.kept[:199].mean() > 0.95 and not rows.kept[200:].any()
