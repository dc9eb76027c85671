"""Language identification against a plain refit: n-grams one by one, and a scalar follow-the-regularised-leader."""

import math
import zlib

import numpy as np
import pytest
import xxhash

from loomrail.llm import catalog, language_id

SF = "/root/testdata/sf0.001"
MASK = 0xFFFFFFFF


def plain_counts(text):
    text, out = text.lower(), {}
    for i in range(len(text)):
        for n in language_id.ORDERS:
            if i + n <= len(text):
                h = 0
                for k, c in enumerate(text[i : i + n], 1):
                    h = (h * 0x9E3779B1 + ord(c) + k) & MASK
                bucket = ((h ^ (h >> 15)) * 0x85EBCA77 & MASK) >> 17
                out[bucket] = out.get(bucket, 0) + 1
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab", "Straße é漢🙂 x\n\n", "İstanbul ΑΣ", "the of and " * 30])
@pytest.mark.parametrize("part", [1 << 20, 7])
def test_ngrams_one_by_one(monkeypatch, text, part):
    monkeypatch.setattr(language_id, "PART", part)
    c = language_id.counts(text)
    assert {int(b): int(c[b]) for b in np.flatnonzero(c)} == plain_counts(text)


class PlainFtrl:
    def __init__(self, classes, model):
        self.classes, self.m, self.z, self.n = classes, model, {}, {}

    def weight(self, key):
        z, n, m = self.z.get(key, 0.0), self.n.get(key, 0.0), self.m
        return 0.0 if abs(z) <= m.l1 else -(z - math.copysign(m.l1, z)) / ((m.beta + math.sqrt(n)) / m.alpha + m.l2)

    def probabilities(self, x, temperature=1.0):
        s = [sum(v * self.weight((b, c)) for b, v in x.items()) / temperature for c in range(self.classes)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    def learn(self, x, label):
        p = self.probabilities(x)
        w = {(b, c): self.weight((b, c)) for b in x for c in range(self.classes)}
        for (b, c), old in w.items():
            g = x[b] * (p[c] - (c == label))
            n = self.n.get((b, c), 0.0)
            self.z[b, c] = self.z.get((b, c), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.m.alpha * old
            self.n[b, c] = n + g * g


def plain_vector(text, idf):
    x = {b: (1 + math.log(c)) * idf(b) for b, c in plain_counts(text).items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    return {b: v / max(size, 1e-12) for b, v in x.items()}


def test_query_as_a_plain_refit(spark):
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(t, lang) for i, t, lang in docs if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    df = {}
    for t, _ in rows:
        for b in plain_counts(t):
            df[b] = df.get(b, 0) + 1
    idf = lambda b: math.log((1 + len(rows)) / (1 + df.get(b, 0))) + 1
    labels = sorted({lang for _, lang in rows})
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    # the sample takes every distinct text of so small a table
    texts = sorted(set(rows), key=lambda r: ((signed(r[0]) * 0x9E3779B1) & MASK, r[1]))
    assert len(texts) < language_id.SAMPLE
    half = lambda x: {b: float(np.float16(v)) for b, v in x.items()}
    data = [({**half(plain_vector(t, idf)), "bias": 0.1}, labels.index(lang)) for t, lang in texts]
    seen, training, aside = {}, [], []
    for x, y in data:
        seen[y] = seen.get(y, 0) + 1
        (training if seen[y] % 5 else aside).append((x, y))
    learner = PlainFtrl(len(labels), language_id.Ftrl(len(labels)))
    for _ in range(3):
        for x, y in training:
            learner.learn(x, y)
    loss = lambda t: -sum(math.log(learner.probabilities(x, t)[y]) for x, y in aside) / max(len(aside), 1)
    temperature = min(np.geomspace(0.3, 5.0, 60), key=loss)
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.languages == labels and model.temperature == pytest.approx(temperature)
    got = {r["doc_id"]: r for r in catalog.queries()["op10_language_id"](spark, SF).collect()}
    for i, t, _ in docs[::3]:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        p = learner.probabilities({**plain_vector(t, idf), "bias": 0.1}, temperature)
        assert got[i]["score"] == pytest.approx(max(p), rel=1e-6)
        assert got[i]["lang_pred"] == labels[p.index(max(p))]


def test_equal_probabilities_go_to_the_first_label():
    model = language_id.Model(["a", "b"], np.ones(language_id.BUCKETS), np.zeros((language_id.BUCKETS + 1, 2)), 1.0)
    assert model.predict("word") == ("a", 0.5) and model.predict("12 !") == model.predict(None) == ("und", 0.0)
