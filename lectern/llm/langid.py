"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams (orders 1 to 3) of the lower-cased text's characters, with whatever is no letter or
combining mark as a blank, are hashed to DIMENSIONS slots. Document frequencies cover every
training document. The weights come from follow-the-regularised-leader with elastic-net
penalties over a bounded sample (PER_LANG documents of each language, by a hash of doc_id
and text), and a temperature, fitted on a part of the sample kept aside, calibrates the
probabilities. The sample's vectors are made by the tasks; the driver gets no text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; documents
without lang are predicted but never learnt from; repeated rows are learnt from once and
each keep their own row; ties between languages go to the alphabetically first; very long
texts are read whole, and their vector has DIMENSIONS entries at most; other columns are not
looked at, whatever their names; without training documents everything is ``und``; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import column, keyed_texts, map_rows, texts

ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 15
#: Sampled training documents of each language, at most.
PER_LANG = 1500
#: Documents of a language that may enter the choice of the sample, as a multiple of PER_LANG.
OVER = 1.3
#: FTRL: learning rate, smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-3, 3

#: What may be a letter: letters, and the numbers that are no decimal digits.
_WORD = re.compile(r"[^\W\d_]")
#: For every character, whether it is a letter or a combining mark.
_KEPT = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L stands in the text."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def slots(text: str) -> np.ndarray:
    """Hashed n-gram slots of a text, one for each position and order."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.where(_KEPT[raw], raw, np.uint32(32))
    blank = raw == 32
    raw = raw[~np.concatenate(([False], blank[1:] & blank[:-1]))]
    out = []
    for n in ORDERS:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint32(0x01000193)
            out.append((h ^ (h >> np.uint32(15))) & np.uint32(DIMENSIONS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, TF-IDF weights of unit length)."""
    counts = np.bincount(slots(text), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(v @ v)
    return at, v / norm if norm else v


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(vectors: list, labels: list[int], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic-net penalties; most weights stay exactly 0."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(11)
    extended = [(np.append(at, DIMENSIONS), np.append(v, 0.1)) for at, v in vectors]
    for _ in range(epochs):
        for k in rng.permutation(len(extended)):
            at, v = extended[k]
            w = weights(z[at], n[at])
            p = softmax(v @ w)
            p[labels[k]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), 0.1 * w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(df of each slot, documents) over all rows."""

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            df = np.zeros(DIMENSIONS, np.int64)
            for t in texts(batch):
                df[np.flatnonzero(np.bincount(slots(t), minlength=DIMENSIONS))] += 1
            at = np.flatnonzero(df)
            return {"slot": np.append(at, -1), "n": np.append(df[at], batch.num_rows)}

        return one

    rows = map_rows(keyed_texts(docs).select("text"), per_task, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 rows
    df, total = np.zeros(DIMENSIONS, np.int64), 0
    for slot, n in rows:
        if slot < 0:
            total = n
        else:
            df[slot] = n
    return df, total


def sampled_vectors(rows: DataFrame, idf: np.ndarray, per_lang: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, slots, weights) of at most per_lang distinct documents of each language, those with the least hash.

    A share of each language by its number of rows comes first, so no language is sorted whole.
    """
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    share = rows.sparkSession.createDataFrame([(r.lang, min(1.0, OVER * per_lang / r["count"])) for r in sizes] or [("", 0.0)], "lang string, share double")
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang")  # one row a language
    near = hashed.where((F.col("h") / float(1 << 64) + 0.5) < F.col("share")).groupBy("lang", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    chosen = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= per_lang).select("lang", "h", "text")  # OVER * per_lang rows a language
    shared = rows.sparkSession.sparkContext.broadcast(idf)  # DIMENSIONS numbers

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            found = [vector(t, shared.value) for t in texts(batch)]
            return {"lang": column(batch, "lang"), "h": column(batch, "h"), "at": [a.astype(np.uint16).tobytes() for a, _ in found], "v": [v.astype(np.float32).tobytes() for _, v in found]}

        return one

    out = map_rows(chosen, per_task, "lang string, h long, at binary, v binary").collect()  # languages times per_lang vectors
    out.sort(key=lambda r: (r.h, r.lang))
    return [(r.lang, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.v, np.float32).astype(np.float64)) for r in out]


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Model from rows (doc_id, text, lang); rows with a null lang or text are left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = sampled_vectors(rows, idf, per_lang)
    langs = sorted({lang for lang, _, _ in sample})
    if not langs:
        return Model([], idf, np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    vectors, labels = [(at, v) for _, at, v in sample], [langs.index(lang) for lang, _, _ in sample]
    held = np.random.default_rng(5).random(len(sample)) < 0.1
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(sample))
    weights, bias = ftrl([vectors[k] for k in fit], [labels[k] for k in fit], len(langs))
    model = Model(langs, idf, weights, bias)
    kept = np.flatnonzero(held)
    if len(kept):
        model.temperature = temperature(np.array([model.logits(*vectors[k]) for k in kept]), np.array([labels[k] for k in kept]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS times languages

    def per_task():
        m = shared.value

        def one(batch: pa.RecordBatch) -> dict:
            found = [m.predict(t) for t in texts(batch)]
            return {"doc_id": column(batch, "doc_id"), "lang_pred": [x for x, _ in found], "score": [p for _, p in found]}

        return one

    return map_rows(keyed_texts(docs), per_task, "doc_id long, lang_pred string, score double")
