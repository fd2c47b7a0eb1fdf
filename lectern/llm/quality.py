"""Quality rules: rule statistics of every text, judged by an isolation forest.

The rules count words, symbols, repeated lines and repeated five-word windows of the
whole text. A document fails outright on fixed limits; the rest is judged by an
isolation forest over all four ratios of those counts: a document that few random splits
cut off from the good rows is anomalous. The trees hold good labelled rows, and split
anywhere in the box that all labelled rows span, so that space where no good row lies is
cut off early. Half of the labelled rows grow the forest, the other half set its threshold:
all of them, counted by tasks, however many there are.

Defined cases: a null or empty text has no words, so all its counts are 0 and it fails
the base rule; repeated rows and ties each keep their own row; very long texts are counted
whole, in linear time; other columns are not looked at; empty tables give empty results;
without good and bad labelled rows nothing but the base rule rejects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import column, keyed_texts, map_rows, texts
from lectern.runtime import cut, discard, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Levels that a tree grows between two counts of all rows; ranges of scores whose sums come to the driver.
LEVELS, RANGES = 4, 4096
TREES, SUBSAMPLE, DEPTH, SEED = 128, 512, 16, 7
#: Caught bad rows, as shares of all bad ones, that a lost good row outweighs.
LOST = 20


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: space and \t..\r only
    blanks = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - blanks,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list) -> int:
    """Words that lie in a five-word window found twice or more."""
    grams = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(grams)) == len(grams):
        return 0
    first: dict = {}
    marked = np.zeros(len(words) + 1, np.int64)
    for at, gram in enumerate(grams):
        was = first.setdefault(gram, at)
        if was != at:
            for x in (was, at):
                marked[x] += 1
                marked[x + WINDOW] -= 1
    return int((np.cumsum(marked[:-1]) > 0).sum())


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the five counts of every whole text."""

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            rows = [rule_counts(t) for t in texts(batch)]
            return {"doc_id": column(batch, "doc_id")} | {c: [r[k] for r in rows] for k, c in enumerate(COUNTS)}

        return one

    return map_rows(keyed_texts(docs), per_task, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios from an (n, 5) array of counts: word length, symbols, repeated lines, repeated words."""
    n, chars, symbols, dup, rep = (counts[:, k].astype(float) for k in range(5))
    per = np.maximum(n, 1)
    return np.column_stack([chars / per, np.minimum(symbols / per, 2), np.log1p(dup), rep / per])


class IsolationForest:
    """Random axis-parallel splits of a box; score 2^(-mean path length / expected length), near 1 if anomalous.

    Every row counts in every tree. A cell is split on while it holds more than its share, 1 in
    ``subsample``, of all rows, so path lengths are those expected of trees of that many rows.
    """

    def __init__(self, rows: np.ndarray, box: tuple[np.ndarray, np.ndarray] | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        low, high = box or (rows.min(0), rows.max(0))
        self._grow(lambda grown: held(grown, rows), len(rows), low, high, trees, subsample, seed)

    @classmethod
    def counted(cls, count: Callable[[list], list[np.ndarray]], n: int, low: np.ndarray, high: np.ndarray) -> IsolationForest:
        """The forest over n rows that only ``count`` sees: how many of them each node of each tree holds as a leaf."""
        out = cls.__new__(cls)
        out._grow(count, n, low, high, TREES, SUBSAMPLE, SEED)
        return out

    def _grow(self, count, n: int, low: np.ndarray, high: np.ndarray, trees: int, subsample: int, seed: int) -> None:
        self.size, self.depth = min(subsample, n), DEPTH
        growing = [_Growing(np.random.default_rng((seed, k)), low, high, n, n / max(1, self.size)) for k in range(trees)]
        for depth in range(0, self.depth, LEVELS):
            for tree in growing:
                tree.split(min(LEVELS, self.depth - depth))
            if not any(tree.fresh for tree in growing):
                break
            for tree, counts in zip(growing, count([tree.arrays() for tree in growing])):
                tree.prune(counts)
        self.trees = [tree.arrays() for tree in growing]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree[4][leaves(tree, x)]
        return 2.0 ** (-total / len(self.trees) / max(_expected(self.size), 1e-9))


class _Growing:
    """A tree whose cells are split some levels ahead of the counts that say which splits stay."""

    def __init__(self, rng, low: np.ndarray, high: np.ndarray, n: int, share: float):
        self.rng, self.share = rng, share
        self.nodes: list = [[-1, 0.0, 0, 0, n, 0, low, high]]  # feature or -1, split, left, right, rows, depth, box
        self.open, self.fresh = [0] if n > share else [], []

    def split(self, levels: int) -> None:
        self.fresh, now = [], self.open
        for _ in range(levels):
            below = []
            for me in now:
                *_, depth, low, high = self.nodes[me]
                wide = np.flatnonzero(high > low)
                if not len(wide):
                    continue
                f = int(self.rng.choice(wide))
                at = float(self.rng.uniform(low[f], high[f]))
                only = np.arange(len(low)) == f
                left = len(self.nodes)
                self.nodes += [[-1, 0.0, 0, 0, 0, depth + 1, low, np.where(only, at, high)], [-1, 0.0, 0, 0, 0, depth + 1, np.where(only, at, low), high]]
                self.nodes[me][:4] = [f, at, left, left + 1]
                self.fresh.append(me)
                below += [left, left + 1]
            now = below

    def prune(self, counts: np.ndarray) -> None:
        """Takes the rows of leaves in, sums them up, and takes back splits of cells with no more than their share."""
        ends = set()
        for me in reversed(self.fresh):
            for side in self.nodes[me][2:4]:
                if self.nodes[side][0] < 0:
                    self.nodes[side][4] = int(counts[side])
                    ends.add(side)
            self.nodes[me][4] = sum(self.nodes[side][4] for side in self.nodes[me][2:4])
        stay = {0}
        for me in self.fresh:
            if self.nodes[me][4] > self.share:
                stay |= set(self.nodes[me][2:4])
            else:
                self.nodes[me][:4] = [-1, 0.0, 0, 0]
        self.open = sorted(x for x in ends & stay if self.nodes[x][4] > self.share)

    def arrays(self) -> list[np.ndarray]:
        """feature or -1, split, left, right and path length of the nodes that the root reaches."""
        order, k = [0], 0
        while k < len(order):
            node = self.nodes[order[k]]
            if node[0] >= 0:
                order += node[2:4]
            k += 1
        place = {old: new for new, old in enumerate(order)}
        kept = [self.nodes[x] for x in order]
        self.nodes = [[x[0], x[1], place[x[2]] if x[0] >= 0 else 0, place[x[3]] if x[0] >= 0 else 0, *x[4:]] for x in kept]
        self.open, self.fresh = [place[x] for x in self.open if x in place], [place[x] for x in self.fresh if x in place]
        length = [0.0 if x[0] >= 0 else x[5] + _expected(x[4] / self.share) for x in self.nodes]
        return [np.array([x[k] for x in self.nodes], t) for k, t in ((0, np.int64), (1, float), (2, np.int64), (3, np.int64))] + [np.array(length)]


def leaves(tree: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf that each row falls in."""
    feature, split, left, right, _ = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            break
        low = x[np.arange(len(x)), np.maximum(f, 0)] <= split[at]
        at = np.where(inner, np.where(low, left[at], right[at]), at)
    return at


def held(trees: list[list[np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """How many rows each leaf of each tree holds."""
    return [np.bincount(leaves(t, x), minlength=len(t[0])) for t in trees]


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def calibrated_threshold(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(threshold, gain): rejecting at >= this score gains most, the share of lost good rows counting LOST times that of caught bad ones.

    Between two neighbouring scores the middle is taken; (2.0, 0.0), which rejects nothing, if no cut helps.
    """
    if not len(scores) or good.all() or not good.any():
        return 2.0, 0.0
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    gain = np.cumsum(~g) / (~g).sum() - LOST * np.cumsum(g) / g.sum()
    gain[:-1][s[:-1] == s[1:]] = -np.inf
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return 2.0, 0.0
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best]), float(gain[best])


@dataclass
class Judge:
    """A forest over the ratios, and the score from which a row is rejected."""

    forest: IsolationForest
    threshold: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        return self.forest.score(features(counts))


def fit_judge(counts: np.ndarray, good: np.ndarray) -> Judge | None:
    """Forest of the even rows, threshold of the odd ones; None if no cut helps."""
    x, grown = features(counts), np.arange(len(counts)) % 2 == 0
    if not (grown & good).any():
        return None
    forest = IsolationForest(x[grown & good], (x[grown].min(0), x[grown].max(0)))
    threshold, gain = calibrated_threshold(forest.score(x[~grown]), good[~grown])
    return Judge(forest, threshold) if gain > 0 else None


RATIOS = ("word_length", "symbols", "dup_lines", "repeats")


def fit(stats: DataFrame, labels: DataFrame) -> Judge | None:
    """Forest and threshold from all labelled rows that pass the base rule, dealt to either by a hash of doc_id.

    Equal rows are counted together. Only counts of cells, sums by ranges of scores and two
    corners of a box come to the driver.
    """
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"))
    grown = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = stats.where(~base_failed()).join(known, "doc_id").select(*COUNTS, "good", grown.alias("grown"))

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            x = features(np.column_stack([column(batch, c).to_numpy() for c in COUNTS]))
            return {c: x[:, k] for k, c in enumerate(RATIOS)} | {c: column(batch, c) for c in ("good", "grown")}

        return one

    ddl = ", ".join(f"{c} double" for c in RATIOS) + ", good boolean, grown boolean"
    rows = written(map_rows(rows, per_task, ddl).groupBy(*RATIOS, "good", "grown").agg(F.count("*").alias("n")))
    corners = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in RATIOS]
    own = rows.where("grown")
    box = own.agg(*corners, F.sum(F.when(F.col("good"), F.col("n"))).alias("good")).first()
    fitted = None
    if box["good"]:
        low, high = (np.array([box[f"{f}_{c}"] for c in RATIOS], float) for f in ("min", "max"))
        forest = IsolationForest.counted(lambda trees: _held(own.where("good"), trees), box["good"], low, high)
        threshold, gain = _threshold(_scored(rows.where("NOT grown"), forest))
        fitted = Judge(forest, threshold) if gain > 0 else None
    discard(rows)
    return fitted


def _held(rows: DataFrame, trees: list[list[np.ndarray]]) -> list[np.ndarray]:
    """held() over all rows: each task counts its own, and leaves meet by tree."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def tasks(batches):
        totals = [np.zeros(len(t[0]), np.int64) for t in sent.value]
        for batch in batches:
            x = np.column_stack([column(batch, c).to_numpy() for c in RATIOS])
            n = column(batch, "n").to_numpy()
            for total, tree in zip(totals, sent.value):
                np.add.at(total, leaves(tree, x), n)
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["tree", "leaf", "n"])

    sums = rows.mapInArrow(tasks, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    out = [np.zeros(len(t[0]), np.int64) for t in trees]
    for tree, leaf, n in sums.collect():  # at most the leaves of all trees
        out[tree][leaf] = n
    sent.unpersist()
    return out


def _scored(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """score, n_good and n_bad of all rows, equal scores together."""
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def per_task():
        return lambda batch: {"score": model.value.score(np.column_stack([column(batch, c).to_numpy() for c in RATIOS]))} | {c: column(batch, c) for c in ("good", "n")}

    one = lambda good: F.sum(F.when(F.col("good") == F.lit(good), F.col("n")).otherwise(0))
    return map_rows(rows, per_task, "score double, good boolean, n long").groupBy("score").agg(one(True).alias("n_good"), one(False).alias("n_bad"))


def _threshold(scored: DataFrame) -> tuple[float, float]:
    """calibrated_threshold() over all rows: running sums over ranges of scores, then inside each range."""
    scored = written(scored.withColumn("range", F.floor(F.col("score") * RANGES).cast("int")))
    sums = sorted(scored.groupBy("range").agg(F.sum("n_good"), F.sum("n_bad")).collect(), key=lambda r: -r[0])  # at most RANGES + 1 rows
    good, bad = sum(r[1] for r in sums), sum(r[2] for r in sums)
    if not good or not bad:
        discard(scored)
        return 2.0, 0.0
    before = [(r[0], sum(x[1] for x in sums[:k]), sum(x[2] for x in sums[:k])) for k, r in enumerate(sums)]
    before = F.broadcast(scored.sparkSession.createDataFrame(before, "range int, good_before long, bad_before long"))
    so_far = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.col(f"{c}_before") + F.sum(f"n_{c}").over(so_far)
    gains = scored.join(before, "range").select("score", (total("bad") / F.lit(float(bad)) - LOST * total("good") / F.lit(float(good))).alias("gain"))
    best = gains.orderBy(F.desc("gain"), F.desc("score")).first()
    under = scored.where(F.col("score") < best.score).agg(F.max("score")).first()[0]
    discard(scored)
    if best.gain <= 0:
        return 2.0, 0.0
    return (best.score + under) / 2 if under is not None else best.score, best.gain


def judge(stats: DataFrame, fitted: Judge | None) -> DataFrame:
    """stats with base_failed, anomaly (0 to 1) and kept."""
    spark = stats.sparkSession
    model = spark.sparkContext.broadcast(fitted)  # a cell with more than its share is split: TREES * 2 * SUBSAMPLE * DEPTH nodes at most
    names = ("doc_id", *COUNTS, "base_failed")

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            x = np.column_stack([column(batch, c).to_numpy() for c in COUNTS])
            anomaly = model.value.score(x) if model.value and len(x) else np.zeros(len(x))
            threshold = model.value.threshold if model.value else 2.0
            failed = column(batch, "base_failed").to_numpy(zero_copy_only=False)
            return {c: column(batch, c) for c in names} | {"anomaly": anomaly, "kept": ~failed & (anomaly < threshold)}

        return one

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return map_rows(stats.withColumn("base_failed", base_failed()).select(*names), per_task, ddl)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, anomaly and kept of every document."""
    stats = cut(rule_statistics(docs))
    return judge(stats, fit(stats, labels))


def filtered(docs: DataFrame, fitted: Judge | None, ddl: str) -> DataFrame:
    """The rows of ``docs`` (columns ``ddl``) that the rules and the forest keep, judged as they stream by."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def per_task():
        def one(batch: pa.RecordBatch) -> dict | None:
            counts = np.array([rule_counts(t) for t in texts(batch)]).reshape(-1, len(COUNTS))
            keep = (counts[:, 0] >= 10) & (100 * counts[:, 4] <= 20 * counts[:, 0])
            if model.value and len(counts):
                keep &= model.value.score(counts) < model.value.threshold
            kept = batch.filter(pa.array(keep))
            return dict(zip(kept.schema.names, kept.columns))

        return one

    return map_rows(docs, per_task, ddl)
