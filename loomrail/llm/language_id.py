"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrail.llm.common import held_out, table

#: n-gram lengths, hashed buckets, and characters hashed at once.
ORDERS, BUCKETS, PART = (1, 2, 3), 1 << 15, 1 << 18
#: Labelled rows for each language, and for all together, from which the classifier is fitted, about (the bounds of the sample).
SAMPLE, TOTAL = 1200, 12000
#: More labels than this are no languages; fit refuses them.
LABELS = 1000
#: A letter is what Unicode calls one (category L); digits, fractions and numerals in circles are none.
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Occurrences of each hashed n-gram of the lower-cased text, counted over the whole of it."""
    total = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for i in range(0, len(text), PART):
        # grams that start in the overlap belong to the next part
        own = min(PART, len(text) - i)
        c = np.frombuffer(text[i : i + PART + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h, parts = np.zeros(len(c), np.uint32), []
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                parts.append(h[:own])
        mixed = np.concatenate(parts)
        total += np.bincount(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(17)).astype(np.int32), minlength=BUCKETS)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length TF-IDF weights of a text."""
    c = counts(text)
    at = np.flatnonzero(c > 0)
    x = (1 + np.log(c[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression with elastic-net penalties."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005

    def __post_init__(self) -> None:
        self.z = np.zeros((BUCKETS + 1, self.classes))
        self.n = np.zeros((BUCKETS + 1, self.classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.r_[at, BUCKETS], np.r_[x, 0.1]
        w = self.weights(at)
        g = np.outer(x, softmax(x @ w) - np.eye(self.classes)[label])
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def plain(self) -> tuple:
        """What a broadcast holds: values that need no class of this package to be read."""
        return self.languages, self.idf, self.weights, self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return "und", 0.0
        at, x = vector(text, self.idf)
        p = softmax((x @ self.weights[at] + 0.1 * self.weights[BUCKETS]) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts that hold each bucket, over all rows; a fixed number of sums reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b["text"].to_pylist():
                df[:-1] += counts(t) > 0
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, passes: int = 3) -> Model:
    """Fit on rows that are not held out and have a label and a text.

    Document frequencies cover all of these rows. The classifier sees about `sample` rows of each
    label (fewer of each if all labels together had over TOTAL), chosen by a hash of the text, and
    each text once, however many copies it has; the fifth, tenth and so on of each label calibrate
    the temperature instead. More than LABELS labels raise an error.
    """
    rows = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label is not null and text is not null")
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    # the rate comes from distinct texts, so that copies take no other text's place
    space = 1 << 30
    hashed = rows.withColumn("h", F.xxhash64("text"))
    size = {r["label"]: r["count"] for r in hashed.select("label", "h").distinct().groupBy("label").count().limit(LABELS + 1).collect()}
    languages = sorted(size)
    if len(languages) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    sample = min(sample, max(TOTAL // max(len(languages), 1), 1))
    if not languages:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    keep = {k: min(space, sample * space // v) for k, v in size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [vector(t, idf) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["label"], b["h"], pa.array([a.astype(np.uint16).tobytes() for a, _ in pairs], pa.binary()), pa.array([x.astype(np.float16).tobytes() for _, x in pairs], pa.binary())], ["label", "h", "at", "x"])

    bound = F.create_map(*(F.lit(v) for kv in keep.items() for v in kv))
    chosen = hashed.where(F.pmod("h", F.lit(space)) < bound[F.col("label")]).dropDuplicates(["label", "h"])
    got = chosen.select("label", "h", "text").mapInArrow(run, "label string, h long, at binary, x binary").collect()
    without = set(languages) - {r["label"] for r in got}
    if without:
        raise ValueError(f"labels without training rows: {sorted(without)}")
    got.sort(key=lambda r: ((r["h"] * 0x9E3779B1) & 0xFFFFFFFF, r["label"], r["at"]))
    data = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float16).astype(np.float64), languages.index(r["label"])) for r in got]
    seen, training, aside = [0] * len(languages), [], []
    for row in data:
        seen[row[2]] += 1
        (training if seen[row[2]] % 5 else aside).append(row)
    learner = Ftrl(len(languages))
    for _ in range(passes):
        for at, x, y in training:
            learner.learn(at, x, y)
    w = learner.weights(slice(None))
    logits = np.array([x @ w[at] + 0.1 * w[BUCKETS] for at, x, _ in aside]).reshape(-1, len(languages))
    truth = np.array([y for *_, y in aside], np.int64)

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(s)), truth]).mean()) if len(s) else 0.0

    # the grid's lower end keeps some doubt where the calibration rows are all right
    grid = np.geomspace(0.3, 5.0, 60)
    return Model(languages, idf, w, float(min(grid, key=loss)))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(doc_id, [keep...,] lang_pred, score) of each row; `und` and 0 for a text that is null or has no letter.

    Labels of equal probability go to the first in order. Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            got = [own.predict(t) for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    names = [id_col, *keep]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def in_known_language(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without those whose language stays undetermined: no letter, or a calibrated probability under `least`.

    docs has doc_id, text and lang; all its columns pass through, whatever their names.
    """
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            got = [own.predict(t) for t in b["text"].to_pylist()]
            yield b.filter(pa.array([p != "und" and s >= least for p, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
