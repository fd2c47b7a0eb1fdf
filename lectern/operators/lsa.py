"""Trained text vectors: latent semantic analysis by a distributed randomised SVD.

Words are hashed to FEATURES columns. A text's row weighs each of its features by
1 + log(count), times log((N + 1) / (df + 0.5)) over all texts, and has unit length. The
leading right singular vectors of that matrix are found by block power iterations: X is
sent to the tasks, each adds up A'(A X) over its rows, the sums meet by blocks of features,
first in SALTS places, and the driver makes the next X orthonormal. A text's vector is its
row in the basis of those singular vectors.

Texts are cut up and counted once. Features that many texts have are multiplied as a dense
matrix, the others entry by entry, so the work goes with what the rows hold.

Everything but the rows is bounded by parameters: X and the model have ``features`` rows of
``dimension`` + OVERSAMPLE numbers. All texts take part in frequencies and sums.

Defined cases: a null text, and one without words, has the zero vector, which matches
nothing; words that no training text has count by their feature's frequency of 0; with fewer
independent rows than dimensions, what is left of the vector is zeros; without texts, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.embedding import DIMENSION, Provider
from lectern.operators.vectors import packed
from lectern.runtime import BATCH_BYTES, BATCH_ROWS, bound_batches, discard, ship, written

FEATURES = 1 << 14
#: Columns of the iterations beyond the wanted ones, and how often they meet the matrix again.
OVERSAMPLE, ITERATIONS = 32, 3
#: Rows that a task multiplies at once, features that travel together, places where their sums meet first.
ROWS, SLICE, SALTS = 32, 256, 16
#: Counted rows that a task multiplies at once, the share of texts from which a feature is multiplied densely, entries gathered at once.
COUNTED_ROWS, OFTEN, GATHERED = 2048, 0.03, 1024
#: At most one in so many features is multiplied densely, which bounds a task's dense matrix.
MOST_OFTEN = 4
#: Words whose feature a task remembers.
REMEMBERED = 1 << 18

_WORD = re.compile(r"\w+")


def features_of(text: str | None, features: int) -> list[int]:
    """The feature of each word of a text."""
    return [crc32(w.encode("utf-8", "surrogatepass")) % features for w in _WORD.findall((text or "").lower())]


class _Features(dict):
    """The feature of each word that a task has met, REMEMBERED of them at most."""

    def __init__(self, features: int):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = crc32(word.encode("utf-8", "surrogatepass")) % self.features
        return found

    def of(self, text: str | None) -> list[int]:
        return list(map(self.__getitem__, _WORD.findall((text or "").lower())))


def counted(texts: DataFrame, text: str = "text", features: int = FEATURES) -> DataFrame:
    """The other columns with features and counts: each distinct feature of a text, in order, and how often the text has it."""
    ship(texts.sparkSession)
    bound_batches(texts.sparkSession)
    others = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features(features)
        for b in batches:
            held = [known.of(t) for t in b.column(0).to_pylist()]
            cells = np.repeat(np.arange(len(held)) * features, [len(f) for f in held]) + np.fromiter(chain.from_iterable(held), np.int64)
            cells, counts = np.unique(cells, return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(held) + 1) * features).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cells % features, counts)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *lists], [*others, "features", "counts"])

    ddl = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in others]
    return texts.select(F.col(text).cast("string").alias("text"), *others).mapInArrow(run, ", ".join([*ddl, "features array<int>, counts array<int>"]))


@dataclass
class _Rows:
    """Counted rows as a sparse matrix A: the row, feature and weight of each entry in order, some features marked as frequent."""

    n: int
    row: np.ndarray
    feature: np.ndarray
    weight: np.ndarray
    often: np.ndarray  # of each feature, its place among the frequent ones, or -1

    @classmethod
    def of(cls, features: pa.ListArray, counts: pa.ListArray, idf: np.ndarray, often: np.ndarray) -> _Rows:
        n, feature = len(features), features.flatten().to_numpy()
        row = np.repeat(np.arange(n), pc.list_value_length(features).to_numpy(zero_copy_only=False).astype(np.int64))
        weight = (1 + np.log(counts.flatten().to_numpy())) * idf[feature]
        norm = np.sqrt(np.bincount(row, weight * weight, n))
        return cls(n, row, feature, (weight / np.where(norm, norm, 1)[row]).astype(np.float32), often)

    def __post_init__(self) -> None:
        place = self.often[self.feature]
        self.dense = np.zeros((self.n, int(self.often.max(initial=-1)) + 1), np.float32)
        self.dense[self.row[place >= 0], place[place >= 0]] = self.weight[place >= 0]
        rare = place < 0
        self.row, self.feature, self.weight = self.row[rare], self.feature[rare], self.weight[rare]

    def times(self, x: np.ndarray, x_often: np.ndarray) -> np.ndarray:
        """A X; x_often holds the frequent features' rows of X."""
        y = self.dense @ x_often
        _add_sums(y, self.row, self.feature, self.weight, x)
        return y

    def add_back(self, z: np.ndarray, z_often: np.ndarray, y: np.ndarray) -> None:
        """Adds A' Y to z, what belongs to frequent features to z_often."""
        z_often += self.dense.T @ y
        order = np.argsort(self.feature.astype(np.min_scalar_type(len(z))), kind="stable")
        _add_sums(z, self.feature[order], self.row[order], self.weight[order], y)


def _add_sums(out: np.ndarray, to: np.ndarray, of: np.ndarray, weight: np.ndarray, x: np.ndarray) -> None:
    """Adds weight times row ``of`` of x to row ``to`` of out, entry by entry; ``to`` is in order."""
    buffer = np.empty((GATHERED, x.shape[1]), x.dtype)
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    for k, at, end in zip(to[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(to)]):
        for lo in range(at, end, GATHERED):
            hi = min(lo + GATHERED, end)
            own = np.take(x, of[lo:hi], axis=0, out=buffer[: hi - lo], mode="clip")
            out[k] += weight[lo:hi] @ own


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTED_ROWS rows at a time, or a bounded number of entries."""
    held, rows, size = [], 0, 0
    for b in batches:
        for k in range(0, b.num_rows, COUNTED_ROWS):
            piece = b.slice(k, COUNTED_ROWS)
            held.append(piece)
            rows, size = rows + piece.num_rows, size + piece.nbytes
            if rows >= COUNTED_ROWS or size >= BATCH_BYTES:
                whole, held, rows, size = pa.concat_batches(held), [], 0, 0
                yield whole
    if held:
        yield pa.concat_batches(held)


def _block(rows: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, A): the features that some rows have, and the rows over them, in single precision. Few rows share few features, so A is not mostly zeros."""
    size = [len(r) for r in rows]
    columns, at = np.unique(np.concatenate([np.asarray(r, np.int64) for r in rows]) if sum(size) else np.zeros(0, np.int64), return_inverse=True)
    counts = np.bincount(np.repeat(np.arange(len(rows)), size) * len(columns) + at, minlength=len(rows) * len(columns)).reshape(len(rows), len(columns))
    a = np.where(counts, 1 + np.log(np.maximum(counts, 1)), 0) * idf[columns]
    norm = np.sqrt((a * a).sum(1, keepdims=True))
    return columns, (a / np.where(norm, norm, 1)).astype(np.float32)


@dataclass
class Model:
    """What fit() learns: weights of features, singular vectors as columns, and singular values; and which features many texts have, if fit() made it."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    frequent: np.ndarray | None = None

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """A row of unit length, or of zeros, a text."""
        out = np.zeros((len(texts), self.basis.shape[1]))
        for k in range(0, len(texts), ROWS):
            columns, a = _block([features_of(t, len(self.idf)) for t in texts[k : k + ROWS]], self.idf)
            out[k : k + ROWS] = a @ self.basis[columns]
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 1e-9, norm, np.inf)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as a table of one row a feature."""
        rows = pd.DataFrame({"feature": np.arange(len(self.idf)), "idf": self.idf, "vector": packed(self.basis).to_pylist()})
        values = pd.DataFrame({"feature": [-1], "idf": [0.0], "vector": [self.values.tobytes()]})
        spark.createDataFrame(pd.concat([values, rows]), "feature long, idf double, vector binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """The model that save() wrote."""
    rows = spark.read.parquet(path).toPandas().sort_values("feature")  # bounded by the parameters of the model
    values = np.frombuffer(rows.vector.iloc[0], np.float64)
    return Model(rows.idf.to_numpy()[1:], np.frombuffer(b"".join(rows.vector.iloc[1:]), np.float32).reshape(-1, len(values)), values)


def provider(spark: SparkSession, model: Model) -> Provider:
    """A provider for embedded() and embed_query(); the model is sent to the tasks once."""
    sent = spark.sparkContext.broadcast(model)  # features x dimension numbers
    return lambda: lambda texts: sent.value.vectors(texts).tolist()


def vectors(rows: DataFrame, model: Model) -> DataFrame:
    """counted() rows with their embedding instead of features and counts."""
    others = [c for c in rows.columns if c not in ("features", "counts")]
    frequent = np.zeros(len(model.idf), bool) if model.frequent is None else model.frequent
    sent = rows.sparkSession.sparkContext.broadcast((model.idf, model.basis, _places(frequent)))  # features x dimension numbers
    width = model.basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, often = sent.value
        x_often = basis[often >= 0]
        for b in _pieces(batches):
            x = _Rows.of(b.column(0), b.column(1), idf, often).times(basis, x_often)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
            x = (x / np.where(norm > 1e-9, norm, np.inf)).astype(np.float32)
            for k in range(0, len(x), BATCH_ROWS):
                some = x[k : k + BATCH_ROWS]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * np.int32(width)), pa.array(some.ravel()))
                yield pa.RecordBatch.from_arrays([*b.slice(k, BATCH_ROWS).columns[2:], lists], [*others, "embedding"])

    ddl = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others]
    return rows.select("features", "counts", *others).mapInArrow(run, ", ".join([*ddl, "embedding array<float>"]))


def _places(frequent: np.ndarray) -> np.ndarray:
    """Of each feature, its place among the frequent ones, or -1."""
    return np.where(frequent, np.cumsum(frequent) - 1, -1)


def _multiplied(rows: DataFrame, idf: np.ndarray, often: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A X) over all counted rows."""
    spark, (features, width) = rows.sparkSession, x.shape
    sent = spark.sparkContext.broadcast((idf, often, x.astype(np.float32)))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, often, x = sent.value
        z, x_often = np.zeros((features, width), np.float32), x[often >= 0]
        z_often = np.zeros_like(x_often)
        seen = np.zeros(-(-features // SLICE), bool)
        for b in _pieces(batches):
            seen[b.column(0).flatten().to_numpy() // SLICE] = True
            a = _Rows.of(b.column(0), b.column(1), idf, often)
            a.add_back(z, z_often, a.times(x, x_often))
        z[often >= 0] = z_often
        salt = TaskContext.get().partitionId() % SALTS
        for s in np.flatnonzero(seen).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([salt], pa.int32()), pa.array([z[s * SLICE : (s + 1) * SLICE].tobytes()])], ["slice", "salt", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                part = np.frombuffer(data, np.float32)
                sums[s] = sums[s] + part if s in sums else part
        for s, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([0], pa.int32()), pa.array([part.tobytes()])], ["slice", "salt", "data"])

    ddl = "slice int, salt int, data binary"
    sums = rows.select("features", "counts").mapInArrow(tasks, ddl).repartition("slice", "salt").mapInArrow(added, ddl).repartition("slice").mapInArrow(added, ddl)
    z = np.zeros((features, width))
    for s, _, data in sums.collect():  # features x width numbers
        part = np.frombuffer(data, np.float32).reshape(-1, width)
        z[s * SLICE : s * SLICE + len(part)] = part
    sent.unpersist()
    return z


def fit(texts: DataFrame, text: str = "text", dimension: int = DIMENSION, features: int = FEATURES, iterations: int = ITERATIONS, seed: int = 0) -> Model:
    """Learns vectors of ``dimension`` numbers from a column of texts."""
    rows = written(counted(texts.select(F.col(text).alias("text")), "text", features))
    model = fit_counted(rows, dimension, features, iterations, seed)
    discard(rows)
    return model


def fit_counted(rows: DataFrame, dimension: int = DIMENSION, features: int = FEATURES, iterations: int = ITERATIONS, seed: int = 0) -> Model:
    """The same from counted() rows, which are read once an iteration."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(features, np.int64), 0
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=features)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, features)), pa.array(np.concatenate([[n], df]))], ["feature", "n"])

    held = rows.select("features").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # one a feature, and -1: all rows
    frequency = np.zeros(features + 1)
    frequency[[r.feature + 1 for r in held]] = [r.n for r in held]
    n, frequency = frequency[0], frequency[1:]
    idf = np.log((n + 1) / (frequency + 0.5))
    frequent = frequency > max(OFTEN * n, np.sort(frequency)[-1 - features // MOST_OFTEN])
    often = _places(frequent)
    width = min(dimension + OVERSAMPLE, features)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    for _ in range(iterations):
        x = np.linalg.qr(_multiplied(rows, idf, often, x))[0]
    z = _multiplied(rows, idf, often, x)
    # Rayleigh-Ritz: the eigenvectors of X'(A'A)X name the singular vectors in the space of X.
    inner = x.T @ z
    squares, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-squares)[:dimension]
    values = np.sqrt(np.maximum(squares[order], 0))
    real = values > max(values.max(initial=0) * 1e-3, 1e-9)
    basis = np.zeros((features, dimension), np.float32)
    basis[:, : len(order)] = (x @ turn[:, order]) * real
    return Model(idf, basis, np.pad(values * real, (0, dimension - len(order))), frequent)
