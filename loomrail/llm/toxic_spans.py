"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens get theirs from the words: in a toxic document, a word is labelled
toxic if the documents that hold it, or words of its beginning, are toxic far more often than chance
allows; every other token is clean. The field (states clean and toxic; features word, neighbours, ending
and beginnings) is trained on these sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import as_bytes, checkpointed, chunks, held_out, table

#: Labelled rows from which everything is learned, about, and bytes of the longest text among them (the bounds of the sample).
SAMPLE, LONGEST = 6000, 1 << 20
#: Evidence (twice a log likelihood ratio) from which a word or a beginning labels its tokens.
EVIDENCE = 24.0
#: Tokens of one training sequence; a longer text is cut into several.
CUT = 256
#: Training sequences without a labelled token for each one with such, and at least so many.
OTHERS, LEAST = 4, 400
#: Bytes of a longer word's beginnings.
BEGINNINGS = (8, 6)
#: Penalties of a word's own weights, its neighbours', its ending's and its beginnings'.
PENALTY = np.array([1e-5, 1e-3, 1e-3, 1e-3, 1e-4, 1e-3])
#: Log odds of a text's likeliest token below which nothing is told from them.
FLOOR = -2.0
#: Bytes of texts tagged together, words whose features are kept, and tokens, padding included, that one recursion runs over.
PART, REMEMBERED, TOGETHER = 1 << 22, 300_000, 1 << 19
EDGES = b".,;:!?\"'()[]{}|<>*#$%&"


def normal(word: bytes) -> bytes:
    return word.lower().strip(EDGES)


def names_of(word: bytes) -> tuple[bytes, ...]:
    """The features of a normal word that stand by themselves: the word, its ending, its beginnings where it is longer."""
    return (word, b"~" + word[-3:], *(b"%d^" % n + word[:n] if len(word) > n else b"" for n in BEGINNINGS))


def odds(e: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the toxic state, without each token's own score in the backward part.

    e: (sequence, token) log odds of the tokens by themselves; mask: which tokens there are; trans[i, j]:
    weight of state j after state i. With two states the recursions need the odds only, which stay
    within the range of doubles, as a step takes them between two ratios of the transitions.
    """
    n, m = e.shape
    own, on = np.exp(np.clip(e.T, -300, 300)), np.ascontiguousarray(mask.T)
    (a, b), (c, d) = np.exp(np.clip(trans - trans.max(), -300, 0))
    forward, backward = np.empty((m, n)), np.ones((m, n))
    r = np.zeros(n)
    for t in range(m):
        r = forward[t] = own[t] * ((b + d * r) / (a + c * r)) if t else own[0].copy()
    r = np.ones(n)
    for t in range(m - 2, -1, -1):
        x = own[t + 1] * r
        r = backward[t] = np.where(on[t + 1], (c + d * x) / (a + b * x), 1.0)
    return np.log(forward).T, np.log(backward).T


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def padded(values: list[np.ndarray], fill=0) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values])
    mask = np.arange(max(size.max(initial=0), 1))[None, :] < size[:, None]
    out = np.full(mask.shape, fill, values[0].dtype if values else np.float64)
    out[mask] = np.concatenate(values)
    return out, mask


class Field:
    """Weights of the words of the training sample by role, and of transitions; unknown words share one row."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, trans: np.ndarray, bias: float) -> None:
        self.vocabulary, self.weights, self.trans, self.bias = vocabulary, weights, trans, bias

    def ids(self, word: bytes) -> tuple[int, ...]:
        return tuple(self.vocabulary.get(n, 0) for n in names_of(normal(word)))

    def token_odds(self, ids: np.ndarray) -> np.ndarray:
        """Log odds of each token of a sequence; ids: a row of feature numbers for each."""
        w = self.weights
        e = w[0, ids[:, 0]] + w[3, ids[:, 1]] + self.bias
        for k in range(len(BEGINNINGS)):
            e += w[4 + k, ids[:, 2 + k]]
        e[1:] += w[1, ids[:-1, 0]]
        e[:-1] += w[2, ids[1:, 0]]
        return e


def evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log likelihood ratio of a of n1 against b of n0 documents, 0 where the first share is not larger."""
    p1, p0, p = a / max(n1, 1), b / max(n0, 1), (a + b) / max(n1 + n0, 1)

    def ll(k, n, q):
        q = np.clip(q, 1e-12, 1 - 1e-12)
        return k * np.log(q) + (n - k) * np.log(1 - q)

    return np.where(p1 > p0, 2 * (ll(a, n1, p1) + ll(b, n0, p0) - ll(a, n1, p) - ll(b, n0, p)), 0.0)


def train_field(texts: list[bytes], toxic: np.ndarray, updates: int = 300, rate: float = 0.3, others: int = OTHERS) -> Field:
    """Learn from whole texts. Of the sequences without a labelled token, `others` for each one with such are taken, evenly spread over the sample (0: all)."""
    words = [[normal(w) for w in t.split()] for t in texts]
    shares: list[dict] = [{}, {}]
    # copies of one text are evidence once for each label
    alike: set = set()
    kept = [0, 0]
    for t, ws, y in zip(texts, words, toxic):
        if (t, bool(y)) in alike:
            continue
        alike.add((t, bool(y)))
        kept[bool(y)] += 1
        into = shares[bool(y)]
        for n in {n for w in set(ws) for n in names_of(w) if n}:
            into[n] = into.get(n, 0) + 1
    clean, bad = shares
    names = sorted(set(bad) | set(clean))
    a, b = (np.array([d.get(n, 0) for n in names], np.float64) for d in (bad, clean))
    first = b"%d^" % BEGINNINGS[0]
    marked = {n for n, g in zip(names, evidence(a, b, kept[1], kept[0])) if g > EVIDENCE}
    vocabulary = {n: i for i, n in enumerate((n for n, k in zip(names, a + b) if k > 2), 1)}
    field = Field(vocabulary, np.zeros((len(PENALTY), len(vocabulary) + 1)), np.zeros((2, 2)), -2.0)

    def labelled(w: bytes) -> bool:
        return w in marked or (len(w) > BEGINNINGS[0] and first + w[: BEGINNINGS[0]] in marked)

    sequences = []
    for ws, y in zip(words, toxic):
        for i in range(0, len(ws), CUT):
            part = ws[i : i + CUT]
            label = np.array([bool(y) and labelled(w) for w in part])
            sequences.append((np.array([[vocabulary.get(n, 0) for n in names_of(w)] for w in part]), label))
    with_span = [s for s in sequences if s[1].any()]
    without = [s for s in sequences if not s[1].any()]
    step = max(1, len(without) // max(others * len(with_span), LEAST)) if others else 1
    data = sorted(with_span + without[::step], key=lambda s: len(s[0]))
    square_w, square_t, square_b = np.full_like(field.weights, 1e-6), np.full((2, 2), 1e-6), 1e-6
    batches = [data[i : i + 64] for i in range(0, len(data), 64)]
    random = np.random.default_rng(7)
    for _ in range(-(-updates // max(len(batches), 1))):
        for k in random.permutation(len(batches)):
            batch = batches[k]
            e, mask = padded([field.token_odds(x) for x, _ in batch])
            gold, _ = padded([y for _, y in batch], False)
            forward, backward = odds(e, mask, field.trans)
            p = sigmoid(forward + backward)
            g = np.where(mask, p - gold, 0.0)
            grad = np.zeros_like(field.weights)
            ids = np.concatenate([x for x, _ in batch])
            d = g[mask]
            inner = np.ones(len(d), bool)
            inner[np.cumsum([len(x) for x, _ in batch])[:-1]] = False
            inner[0] = False
            size = grad.shape[1]
            for k, column in ((0, 0), (3, 1), *((4 + i, 2 + i) for i in range(len(BEGINNINGS)))):
                grad[k] = np.bincount(ids[:, column], weights=d, minlength=size)
            grad[1] = np.bincount(ids[:-1, 0][inner[1:]], weights=d[1:][inner[1:]], minlength=size)
            grad[2] = np.bincount(ids[1:, 0][inner[1:]], weights=d[:-1][inner[1:]], minlength=size)
            # expected less observed transitions, from the pair marginals
            grad_t = np.zeros((2, 2))
            if e.shape[1] > 1:
                pairs = mask[:, 1:]
                scores = np.stack([np.stack([field.trans[i, j] + i * forward[:, :-1] + j * (e[:, 1:] + backward[:, 1:]) for j in (0, 1)]) for i in (0, 1)])
                scores = np.exp(scores - scores.max(axis=(0, 1)))
                scores /= scores.sum(axis=(0, 1))
                for i in (0, 1):
                    for j in (0, 1):
                        grad_t[i, j] = ((scores[i, j] - ((gold[:, :-1] == i) & (gold[:, 1:] == j))) * pairs).sum()
            grad = grad / len(batch) + PENALTY[:, None] * field.weights
            grad_t, grad_b = grad_t / len(batch), g.sum() / len(batch)
            square_w += grad**2
            square_t += grad_t**2
            square_b += grad_b**2
            field.weights -= rate * grad / np.sqrt(square_w)
            field.trans -= rate * grad_t / np.sqrt(square_t)
            field.bias -= rate * grad_b / np.sqrt(square_b)
    return field


def features(p: np.ndarray) -> np.ndarray:
    """Of one text's marginals: the highest log odds, and the expected number of toxic tokens on a log scale."""
    if not len(p):
        return np.array([FLOOR, 0.0])
    top = np.clip(p.max(), 1e-6, 1 - 1e-6)
    return np.array([max(np.log(top / (1 - top)), FLOOR), np.log1p(p[p > sigmoid(FLOOR)].sum())])


def marginals(field: Field, texts: list[bytes]) -> list[np.ndarray]:
    """Marginal probability of the toxic state for every token of every text, the whole sequence at once."""
    known: dict = {}
    ids = []
    for t in texts:
        ws = t.split()
        for w in ws:
            if w not in known:
                known[w] = field.ids(w)
        ids.append(np.array([known[w] for w in ws], np.int32).reshape(-1, 2 + len(BEGINNINGS)))
        if len(known) > REMEMBERED:
            known.clear()
    order = sorted(range(len(texts)), key=lambda i: len(ids[i]))
    out: list = [np.zeros(0)] * len(texts)
    at = next((i for i, r in enumerate(order) if len(ids[r])), len(order))
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(ids[order[to]]) <= TOGETHER:
            to += 1
        e, mask = padded([field.token_odds(ids[r]) for r in order[at:to]])
        forward, backward = odds(e, mask, field.trans)
        p = sigmoid(forward + backward)
        for k, r in enumerate(order[at:to]):
            out[r] = p[k, : len(ids[r])]
        at = to
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * np.r_[w[:-1], 0.0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[np.full(x.shape[1] - 1, ridge), 1e-6])
        w = w - np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """Field and score weights, as plain values, from about `sample` labelled rows that are not held out.

    docs: doc_id, text. labels: doc_id, toxic; a null label teaches nothing. Rows of one text and label
    count once; they are chosen by a hash of the text, among texts of LONGEST bytes at most, and only
    these texts reach the driver. Text alone is learned from. Without rows of both labels every text
    gets one and the same score.
    """
    learnable = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    space = 1 << 30
    # the join needs no text, only its hash; one row for each distinct text and label
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    short = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST)
    distinct = short.select("doc_id", h.alias("h")).join(learnable, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
    distinct = checkpointed(distinct)
    bound = min(space, sample * space // max(distinct.count(), 1))
    chosen = distinct.where(F.pmod("h", F.lit(space)) < bound)
    # at most about `sample` short rows, so they may be broadcast; an id may stand for several texts
    rows = docs.select("doc_id", "text").withColumn("h", h).join(F.broadcast(chosen), ["doc_id", "h"]).select("h", "text", "toxic").dropDuplicates(["h", "toxic"]).orderBy("h", "toxic").select("text", "toxic").collect()
    texts, toxic = [(r["text"] or "").encode() for r in rows], np.array([r["toxic"] == 1 for r in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return {}, np.zeros((len(PENALTY), 1)), np.zeros((2, 2)), -2.0, np.array([0.0, 0.0, 2.0 if len(rows) and toxic.all() else -4.0])
    # the score is fitted on marginals of rows that another field than their own was trained on
    halves = [np.arange(len(texts)) % 2 == k for k in (0, 1)]
    x = np.zeros((len(texts), 2))
    for own in halves:
        other = np.flatnonzero(~own)
        part = train_field([texts[i] for i in other], toxic[other], 150)
        here = np.flatnonzero(own)
        x[here] = [features(p) for p in marginals(part, [texts[i] for i in here])]
    field = train_field(texts, toxic)
    return field.vocabulary, field.weights, field.trans, field.bias, logistic(x, toxic.astype(float))


def tagged(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", span: float = 0.5) -> DataFrame:
    """(doc_id, score, spans) of each row: spans are byte ranges of consecutive tokens whose marginal is at least `span`.

    Null and empty texts have no spans and the score of a text without any sign. Whole texts are tagged;
    repeated rows stay; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, weights = shared.value
        field = Field(*parts)
        for b in batches:
            texts = as_bytes(b["text"])
            score, spans = [], []
            for i, j in chunks(texts, PART):
                found = marginals(field, texts[i:j])
                x = np.array([features(p) for p in found]).reshape(-1, 2)
                score.append(sigmoid(np.c_[x, np.ones(len(x))] @ weights))
                spans += [offsets(t, p, span) for t, p in zip(texts[i:j], found)]
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["_id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, score double, spans array<struct<start: bigint, end: bigint>>").withColumnRenamed("_id", id_col)


def offsets(text: bytes, p: np.ndarray, least: float) -> list[dict]:
    out: list[dict] = []
    hit = np.flatnonzero(p >= least)
    if not len(hit):
        return out
    at, last = 0, -2
    wanted = set(hit.tolist())
    for k, w in enumerate(text.split()):
        at = text.index(w, at)
        if k in wanted:
            if k == last + 1 and out:
                out[-1]["end"] = at + len(w)
            else:
                out.append({"start": at, "end": at + len(w)})
            last = k
        at += len(w)
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = tagged(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
