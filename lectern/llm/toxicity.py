"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

Training counts in how many toxic and other labelled documents each word stands, and takes
log-odds under a Dirichlet prior that follows the word's frequency over all documents.
Words whose log-odds are significant, for or against, make the lexicon and score them; all
other words are one class, which scores its own, negative log-odds (the drift). A
linear-time scan finds all maximal scoring segments of a text; a segment of score S in n
words is significant if K n exp(-lambda S) is small (Karlin-Altschul): lambda solves the
score equation over the token frequencies of clean text, and K is fitted to the number of
segments in clean documents that were kept aside. The sum over significant segments of
lambda S - ln(K n) is mapped to a probability by a logistic fit on the documents kept aside,
and with both fitted the lexicon is made once more of all labelled documents.

Defined cases: null texts are empty, have no segment and get the score of a text without
any; label rows without a document, and null labels, are ignored; a doc_id labelled both
ways counts as toxic; repeated rows are learnt from once and each keep their own row; very
long texts are scored whole, in linear time; other columns are not looked at, whatever their
names; without training rows every score is the prior 0; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import column, keyed_texts, map_rows, texts
from lectern.runtime import cut

#: Labelled documents of each class that words are counted in, at most.
PER_CLASS = 20_000
#: Toxic documents a lexicon word must stand in; its z-score and log-odds at least.
LEAST, Z, ODDS = 3, 2.5, 1.5
#: Mass of the Dirichlet prior, as a multiple of the toxic documents counted.
PRIOR = 1.0
CLIP, E_VALUE = 6.0, 0.05
#: Expected toxic documents of a word that may count against toxicity; mean score of a clean word, at most; documents kept aside, one in so many.
EXPECTED, SLOPE, ASIDE = 8, -0.02, 3
#: Rows of a class that have to be aside for the calibration; with fewer all rows serve for it.
ENOUGH = 10

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word + 1, score), in linear time.

    hits: (word index, score) of lexicon words; the words between score -drift each.
    Segments are kept as a stack of (start, end, sum before, sum after); a new one is merged
    with the nearest earlier one that begins lower while that raises the sum.
    """
    stack: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each, the nearest earlier segment whose left sum is less
    total, last = 0.0, -1
    for at, score in hits:
        total -= drift * (at - last - 1)
        start, left = at, total
        total += score
        last, right = at, total
        if score <= 0:
            continue
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, at + 1, left, right))
                lower.append(j)
                break
            start, _, left, _ = stack[j]
            del stack[j:], lower[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 0.0
    offset: float = -20.0

    def segments_of(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every maximal scoring segment of a text."""
        get = self.lexicon.get
        return segments([(k, s) for k, s in enumerate(map(get, words)) if s is not None], self.drift)

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first word, last word + 1, score, excess) of every significant segment."""
        if not words:
            return []
        base = np.log(self.scale * len(words))
        found = [(a, b, s, self.rate * s - base) for a, b, s in self.segments_of(words)]
        return [x for x in found if x[3] >= -np.log(E_VALUE)]

    def score(self, excess: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * excess + self.offset, -30, 30))))


def excess_of(passages: list[tuple]) -> float:
    return float(np.log1p(sum(x[3] for x in passages)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, n_toxic: float, n_clean: float, n_corpus: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z-scores) of words with a Dirichlet prior in proportion to corpus counts."""
    mass = PRIOR * n_toxic
    prior = mass * np.maximum(corpus, 1) / max(n_corpus, 1)
    t, c = toxic + prior, clean + prior
    odds = np.log(t / np.maximum(n_toxic + mass - t, 1e-9)) - np.log(c / np.maximum(n_clean + mass - c, 1e-9))
    return odds, odds / np.sqrt(1 / t + 1 / c)


def decay(scores: np.ndarray, rates: np.ndarray) -> float:
    """lambda > 0 with sum of rate exp(lambda score) = 1; the mean score is negative and some score positive."""
    f = lambda x: (rates * np.exp(scores * x)).sum() - 1
    low, high = 1e-6, 1e-6
    while f(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fitted_scale(sizes: np.ndarray, scores: list[np.ndarray], rate: float) -> float:
    """K from segments of clean texts: their number above a score is K n exp(-rate score), summed over the texts' n words.

    The score is that of the median segment; half a segment is added to the count.
    """
    every = np.concatenate(scores) if scores else np.zeros(0)
    level = float(np.median(every)) if len(every) else 1.0 / rate
    return float(((every >= level).sum() + 0.5) / max(sizes.sum(), 1.0) * np.exp(rate * level))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    w = np.zeros(2)
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from labelled documents (doc_id, toxic), at most ``per_class`` of each class by a hash of doc_id."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda c: known.where(c).orderBy(F.xxhash64("doc_id")).limit(per_class)
    chosen = cut(pick(F.col("toxic")).unionByName(pick(~F.col("toxic"))).withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(ASIDE)), F.lit(ASIDE)) == 0))
    rows = keyed_texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("th", F.xxhash64("text"))  # 2 * per_class ids
    rows = cut(rows.groupBy("doc_id", "th", "toxic", "aside").agg(F.first("text").alias("text")))
    sizes = {(r.toxic, r.aside): r["count"] for r in rows.groupBy("toxic", "aside").count().collect()}
    every = {t: sum(n for (x, _), n in sizes.items() if x is t) for t in (True, False)}
    if not every[True]:
        return Model()
    whole = min(sizes.get((t, True), 0) for t in (True, False)) < ENOUGH or not sizes.get((True, False))  # too few to keep any aside
    counted = map_rows(rows.select("text", "toxic", "aside"), _counted, "word string, toxic boolean, aside boolean, docs long, tokens long")
    one = lambda c, toxic, which: F.sum(F.when((F.col("toxic") == toxic) & which, F.col(c)).otherwise(0))
    parts = {"learnt": F.lit(True) if whole else ~F.col("aside"), "all": F.lit(True)}
    columns = [one(c, t, which).alias(f"{name}_{c}_{t}") for name, which in parts.items() for c in ("docs", "tokens") for t in (True, False)]
    counted = cut(counted.groupBy("word").agg(*columns))
    totals = counted.agg(*[F.sum(c).alias(c) for c in counted.columns if c != "word"]).first()
    docs_of = {"learnt": every if whole else {t: sizes.get((t, False), 0) for t in (True, False)}, "all": every}

    def telling(name: str) -> F.Column:
        toxic, clean = F.col(f"{name}_docs_True"), F.col(f"{name}_docs_False")
        share = docs_of[name][True] / max(docs_of[name][False], 1)
        speaks_for = (toxic >= LEAST) & (toxic >= float(np.exp(ODDS)) * share * clean)
        return speaks_for | ((clean * share >= EXPECTED) & (2 * toxic <= clean * share))

    maybe = counted.where(telling("learnt") | telling("all")).collect()  # words of a bounded sample
    maybe.sort(key=lambda r: r.word)
    corpus, n_corpus = corpus_counts(docs, [r.word for r in maybe])

    def lexicon(name: str) -> Model:
        of = lambda c, t: np.array([r[f"{name}_{c}_{t}"] for r in maybe], float)
        odds, z = log_odds(of("docs", True), of("docs", False), corpus, docs_of[name][True], docs_of[name][False], n_corpus)
        good = (np.abs(z) >= Z) & (((odds >= ODDS) & (of("docs", True) >= LEAST)) | (odds < 0))
        scores = np.clip(odds[good], -CLIP, CLIP)
        if not (scores > 0).any():
            return Model()
        model = Model(dict(zip((r.word for r, g in zip(maybe, good) if g), scores.tolist())))
        # Token frequencies of clean text, half a token added to each word; all other words are one class.
        n_clean, n_toxic = totals[f"{name}_tokens_False"], totals[f"{name}_tokens_True"]
        rates = (of("tokens", False)[good] + 0.5) / (n_clean + 0.5 * good.sum() + 1.0)
        rest = max(1e-9, 1 - rates.sum())
        rest_toxic = max(1e-9, 1 - of("tokens", True)[good].sum() / max(n_toxic, 1))
        # The drift is at least so large that a clean word scores below zero in the mean.
        model.drift = float(max(-np.log(rest_toxic / rest), (rates @ scores - SLOPE) / rest))
        model.rate = decay(np.append(scores, -model.drift), np.append(rates, rest))
        return model

    first = lexicon("learnt")
    if not first.lexicon:
        return Model()
    shared = spark.sparkContext.broadcast(first)

    def measured():
        def one(batch: pa.RecordBatch) -> dict:
            words = [words_of(t) for t in texts(batch)]
            return {"toxic": column(batch, "toxic"), "n": [len(w) for w in words], "scores": [[s for *_, s in shared.value.segments_of(w)] for w in words]}

        return one

    fit = map_rows((rows if whole else rows.where("aside")).select("text", "toxic"), measured, "toxic boolean, n long, scores array<double>").collect()  # at most 2 * per_class rows
    clean = [r for r in fit if not r.toxic]
    scale = fitted_scale(np.array([r.n for r in clean], float), [np.array(r.scores) for r in clean], first.rate)
    excess = [[(0, 0, s, x) for s in r.scores if (x := first.rate * s - np.log(scale * r.n)) >= -np.log(E_VALUE)] for r in fit]
    slope, offset = logistic(np.array([excess_of(x) for x in excess]), np.array([float(r.toxic) for r in fit]))
    model = lexicon("all")  # what was measured aside holds for the lexicon of all rows
    model.scale, model.slope, model.offset = scale, slope, offset
    return model


def _counted():
    """Documents and tokens of each word in a batch, by class and whether kept aside."""

    def one(batch: pa.RecordBatch) -> dict:
        docs, tokens = Counter(), Counter()
        for text, toxic, aside in zip(texts(batch), column(batch, "toxic").to_pylist(), column(batch, "aside").to_pylist()):
            own = Counter(words_of(text))
            docs.update((w, toxic, aside) for w in own)
            for w, n in own.items():
                tokens[w, toxic, aside] += n
        word, toxic, aside = zip(*docs) if docs else ((), (), ())
        return {"word": word, "toxic": toxic, "aside": aside, "docs": list(docs.values()), "tokens": [tokens[k] for k in docs]}

    return one


def corpus_counts(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """(documents that hold each word, documents), over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})  # words of a bounded sample

    def per_task():
        index = shared.value

        def one(batch: pa.RecordBatch) -> dict:
            n = np.zeros(len(index), np.int64)
            for t in texts(batch):
                n[[index[w] for w in index.keys() & set(words_of(t))]] += 1
            at = np.flatnonzero(n)
            return {"word": np.append(at, -1), "n": np.append(n[at], batch.num_rows)}

        return one

    rows = map_rows(keyed_texts(docs).select("text"), per_task, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return np.array([found.get(k, 0) for k in range(len(names))], float), found.get(-1, 0)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (word range, score and excess over the extreme-value level) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_task():
        m = shared.value

        def one(batch: pa.RecordBatch) -> dict:
            found = [m.passages(words_of(t)) for t in texts(batch)]
            return {
                "doc_id": column(batch, "doc_id"), "score": [m.score(excess_of(x)) for x in found],
                "passages": [[{"start": a, "end": b, "score": s, "excess": e} for a, b, s, e in x] for x in found],
            }

        return one

    return map_rows(keyed_texts(docs), per_task, "doc_id long, score double, passages array<struct<start: int, end: int, score: double, excess: double>>")
