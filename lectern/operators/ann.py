"""Approximate nearest neighbours: an inverted file over k-means lists with product-quantised residuals.

Build. Spark's k-means (cosine) makes the centres of the lists from a sample of at most about
SAMPLE vectors. What is left of a unit vector without its centre is cut into subspaces, and one
task a subspace finds CODES codewords for the sample's pieces. Every vector then gets its list,
its code (a byte a subspace) and stays itself beside them, in Parquet range-partitioned and
sorted by list and a hash of the id, so a list that holds a third of all vectors is shared by
files, and a search reads the files of its lists alone. Last, a sample of stored vectors is
asked: the number of lists to probe, and of candidates to compare exactly, are the least that
find GOAL of their true neighbours, so they follow the data and not a guess.

Search, for any number of questions in one job: each question goes to its nearest lists, and
vectors and questions meet in one shuffle by list and part (a list's parts hold about PART
vectors). A task holds the codes of one part, and questions stream by: it sends on the best
candidates of each by codes, and the best of those over all parts are compared by their
vectors. exact() compares vectors at once, in the lists probed, or in all of them: then the
answer is that of a search without an index.

Defined cases: vectors that are null, zero, not finite, have a null in them or another length
than most of the sample are not indexed, and as questions match nothing; ids are distinct (a
question whose id stands twice gets the nearest of either); ties go by chunk id; an empty table
gives an index without rows, whose answers are empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.vector_search import ROUND
from lectern.operators.vectors import best, matrix, packed, unit, unpacked
from lectern.runtime import bound_batches, discard, ship, written

#: Vectors that centres and codewords are learnt from, about; at least so many a list.
SAMPLE, PER_LIST = 32_768, 16
#: Lists at most; codewords of a subspace at most; dimensions of a subspace.
LISTS, CODES, PIECE = 16_384, 256, 4
#: Vectors of a part of a list, about.
PART = 65_536
#: Stored vectors that are asked to set probes and candidates, their neighbours, and the share of these to be found by each of the two.
ASKED, NEIGHBOURS, GOAL = 128, 10, 0.98
#: Questions compared with a part at once.
BLOCK = 64
#: Products of vectors and centres that a task holds at once; rows that it makes of questions at once.
CELLS, ROUTED = 1 << 20, 1 << 14
#: Lists up to which a search names the lists that it reads.
NAMED = 1_000

_ANSWER = "query_id long, chunk_id long, list int, score double"


def _hash():
    return F.xxhash64("id")


class AnnIndex:
    """The index below a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ship(spark)
        bound_batches(spark)
        about = spark.read.parquet(f"{self.path}/about").first()
        self.size, self.probes, self.rerank = about.size, about.probes, about.rerank
        lists = spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()  # at most LISTS rows
        self.centres = np.array([np.frombuffer(r.centre, np.float32) for r in lists], np.float32).reshape(len(lists), self.size)
        words = spark.read.parquet(f"{self.path}/words").orderBy("piece").collect()  # one row a subspace
        self.words = np.array([np.frombuffer(r.words, np.float32).reshape(-1, PIECE) for r in words], np.float32)
        self.counts = spark.read.parquet(f"{self.path}/counts")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, lists: int = 0) -> AnnIndex:
        """Indexes (id, embedding); lists: their number, else the square root of the rows."""
        spark, path = chunks.sparkSession, path.rstrip("/")
        ship(spark)
        bound_batches(spark)
        rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        total = rows.where("embedding is not null").count()
        lists = max(1, min(lists or round(total**0.5), LISTS))
        most = max(SAMPLE, PER_LIST * lists)
        sample = rows.where(F.col("embedding").isNotNull())
        if total > most:
            sample = sample.where(F.pmod(_hash(), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total)))
        sample = written(sample)
        common = sample.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = common["size"] if common else PIECE
        good = (F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        centres = cls._centres(sample.where(good), lists, size)
        words = cls._words(sample, centres)
        discard(sample)
        encoded = _encoded(rows, centres, words)
        encoded.repartitionByRange("list", "hash").sortWithinPartitions("list", "hash").write.parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        stored.groupBy("list").agg(F.count("*").alias("n")).select("list", "n", F.ceil(F.col("n") / PART).cast("int").alias("parts")).write.parquet(f"{path}/counts")
        spark.createDataFrame(pd.DataFrame({"list": range(len(centres)), "centre": [c.tobytes() for c in centres]}), "list int, centre binary").write.parquet(f"{path}/lists")
        spark.createDataFrame(pd.DataFrame({"piece": range(len(words)), "words": [w.tobytes() for w in words]}), "piece int, words binary").write.parquet(f"{path}/words")
        about = lambda probes, rerank, mode: spark.createDataFrame([(size, probes, rerank)], "size int, probes int, rerank int").write.mode(mode).parquet(f"{path}/about")
        about(len(centres), 1, "error")
        about(*cls(spark, path)._calibrated(), "overwrite")
        return cls(spark, path)

    @staticmethod
    def _centres(sample: DataFrame, lists: int, size: int) -> np.ndarray:
        vectors = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
        n = vectors.count()
        if n < 2 or lists < 2:
            vectors.unpersist()
            first = sample.select("embedding").first()
            return np.array([first.embedding if first else [1.0] + [0.0] * (size - 1)], np.float32)
        model = KMeans(k=min(lists, n), maxIter=10, seed=7, distanceMeasure="cosine").fit(vectors)
        vectors.unpersist()
        return unit(np.array(model.clusterCenters())).astype(np.float32)

    @staticmethod
    def _words(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
        """Codewords of each subspace: one group a subspace, of the sample's pieces."""
        size = centres.shape[1]
        pieces = -(-size // PIECE)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, x = matrix(b.column(0), size)
                if len(x):
                    parts = _pieces(_left(unit(x), centres, _nearest(unit(x), centres, 1)[:, 0]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(pieces, dtype=np.int32), len(x))), packed(parts.transpose(1, 0, 2).reshape(-1, PIECE).astype(np.float32))], ["piece", "x"])

        def learn(group: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(group.x), np.float32).reshape(-1, PIECE).astype(np.float64)
            return pd.DataFrame({"piece": [group.piece.iloc[0]], "words": [_codewords(x).astype(np.float32).tobytes()]})

        found = sample.select("embedding").mapInArrow(cut, "piece int, x binary").groupBy("piece").applyInPandas(learn, "piece int, words binary").collect()  # one row a subspace
        out = np.zeros((pieces, CODES, PIECE), np.float32)
        for r in found:
            own = np.frombuffer(r.words, np.float32).reshape(-1, PIECE)
            out[r.piece] = own[np.minimum(np.arange(CODES), len(own) - 1)]
        return out

    def _calibrated(self) -> tuple[int, int]:
        """Probes and candidates from what the nearest of some stored vectors need."""
        stored = self.spark.read.parquet(f"{self.path}/rows")
        total = stored.count()
        asked = stored.where(F.pmod(F.col("hash"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 4 * ASKED / max(1, total))))).orderBy("hash").limit(ASKED).select(F.col("id").alias("query_id"), "vector")
        asked = written(asked)
        questions = asked.collect()  # at most ASKED
        if not questions:
            return 1, 1
        true = self._met(asked, len(self.centres), NEIGHBOURS, exact=True).collect()  # at most ASKED * NEIGHBOURS
        q = unit(np.array([np.frombuffer(r.vector, np.float32) for r in questions], np.float64))
        order = _nearest(q, self.centres, len(self.centres))
        place = {r.query_id: {lst: k for k, lst in enumerate(own.tolist())} for r, own in zip(questions, order)}
        ranks = [place[r.query_id][r.list] for r in true]
        probes = int(np.quantile(ranks, GOAL, method="higher")) + 1
        near = self._met(asked, probes, 64 * NEIGHBOURS, exact=False).select("query_id", "chunk_id", "nth").collect()  # at most 64 times as many
        nth = {(r.query_id, r.chunk_id): r.nth for r in near}
        own = [nth.get((r.query_id, r.chunk_id), 64 * NEIGHBOURS) for r in true if place[r.query_id][r.list] < probes]
        discard(asked)
        return probes, -(-int(np.quantile(own, GOAL, method="higher")) // NEIGHBOURS)

    def _questions(self, queries: DataFrame) -> DataFrame:
        """query_id and vector, packed, of the questions that can match."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = matrix(b.column(1), size)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), packed(x.astype(np.float32))], ["query_id", "vector"])

        return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, "query_id long, vector binary")

    def _met(self, questions: DataFrame, probes: int, limit: int, exact: bool) -> DataFrame:
        """query_id, chunk_id, list, score (least is nearest) and nth of the ``limit`` best of each question in its nearest lists."""
        size, centres, words = self.size, self.centres, self.words

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                step = max(1, ROUTED // probes)
                for k in range(0, b.num_rows, step):
                    own = b.slice(k, step)
                    near = _nearest(unit(unpacked(own.column(1), np.float32, size).astype(np.float64)), centres, probes)
                    at = pa.array(np.repeat(np.arange(own.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([own.column(0).take(at), pa.array(near.ravel()), own.column(1).take(at)], ["id", "list", "data"])

        asked = questions.select("query_id", "vector").mapInArrow(route, "id long, list int, data binary")
        stored = self.spark.read.parquet(f"{self.path}/rows")
        if probes < len(centres):
            named = [r.list for r in asked.select("list").distinct().limit(NAMED + 1).collect()]
            if len(named) <= NAMED:  # so that only the files of these lists are read
                stored = stored.where(F.col("list").isin(named))
        parts = F.broadcast(self.counts.select("list", "parts"))  # at most LISTS rows
        asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "data")
        stored = stored.join(parts, "list").select("list", F.pmod("hash", F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "id", F.col("vector" if exact else "code").alias("data"))
        both = stored.unionByName(asked).repartition("list", "part").sortWithinPartitions("list", "part", "kind")

        def answer(lst: int, ids: np.ndarray, data: np.ndarray, names: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            if exact:
                score = np.round(-(q @ data.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((data * data).sum(1)), ROUND)
            else:
                left = _pieces(_left(unit(q), centres, np.full(len(q), lst)))
                score = np.zeros((len(q), len(ids)))
                for m in range(len(words)):
                    score += ((left[:, m, None, :] - words[m][None]) ** 2).sum(2)[:, data[:, m]]
            order = best(score, ids, limit)
            n = order.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(ids[order].ravel()), pa.array(np.full(order.size, lst, np.int32)), pa.array(np.take_along_axis(score, order, 1).ravel())], ["query_id", "chunk_id", "list", "score"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, data, ready = None, [], [], None
            for b in batches:
                lists, part, kind, names = (b.column(k).to_numpy() for k in range(4))
                changes = np.flatnonzero((np.diff(lists) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
                for low, high in zip([0, *changes], [*changes, b.num_rows]):
                    if low == high:
                        continue
                    here = (int(lists[low]), int(part[low]))
                    if here != now:
                        now, ids, data, ready = here, [], [], None
                    own = b.column(4).slice(low, high - low)
                    if kind[low] == 0:
                        ids.append(names[low:high])
                        data.append(unpacked(own, np.float32, size) if exact else unpacked(own, np.uint8, len(words)))
                        continue
                    if not ids:
                        continue
                    if ready is None:
                        ready = (np.concatenate(ids), np.concatenate(data).astype(np.float64 if exact else np.uint8))
                    q = unpacked(own, np.float32, size).astype(np.float64)
                    for k in range(0, len(q), BLOCK):
                        yield answer(here[0], *ready, names[low + k : min(low + k + BLOCK, high)], q[k : k + BLOCK])

        found = both.mapInArrow(meet, _ANSWER)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= limit)

    def exact(self, queries: DataFrame, limit: int, probes: int = 0) -> DataFrame:
        """(query_id, chunk_id, sim): the nearest of the vectors in ``probes`` lists of each question, or in all lists."""
        found = self._met(self._questions(queries), min(probes or len(self.centres), len(self.centres)), limit, exact=True)
        return found.select("query_id", "chunk_id", (-F.col("score")).alias("sim"))

    def search(self, queries: DataFrame, limit: int, probes: int = 0, rerank: int = 0) -> DataFrame:
        """(query_id, chunk_id, sim) of the approximately nearest; by default with the index's own probes, and candidates for each answer."""
        questions = self._questions(queries)
        near = self._met(questions, min(probes or self.probes, len(self.centres)), limit * (rerank or self.rerank), exact=False)
        size = self.size
        stored = self.spark.read.parquet(f"{self.path}/rows").select("list", F.col("id").alias("chunk_id"), "vector")
        pairs = near.select("query_id", "chunk_id", "list").join(stored, ["list", "chunk_id"]).join(questions.withColumnRenamed("vector", "asked"), "query_id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, y = (unpacked(b.column(k), np.float32, size).astype(np.float64) for k in (2, 3))
                    sim = np.round((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), ROUND)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], ["query_id", "chunk_id", "sim"])

        scored = pairs.select("query_id", "chunk_id", "vector", "asked").mapInArrow(compare, "query_id long, chunk_id long, sim double")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id"))
        return scored.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each unit vector, the nearest first; CELLS products are held at once, however many lists there are."""
    columns = centres.T.astype(np.float64)
    out = np.empty((len(x), min(n, len(centres))), np.int32)
    step = max(1, CELLS // len(centres))
    for k in range(0, len(x), step):
        far = -(x[k : k + step] @ columns)
        out[k : k + step] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, 1, kind="stable")[:, :n]
    return out


def _left(x: np.ndarray, centres: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What is left of vectors without their centres."""
    return x - centres[at]


def _pieces(x: np.ndarray) -> np.ndarray:
    """Vectors cut into subspaces, the last filled up with zeros."""
    n = -(-x.shape[1] // PIECE)
    return np.pad(x, ((0, 0), (0, n * PIECE - x.shape[1]))).reshape(len(x), n, PIECE)


def _codewords(x: np.ndarray) -> np.ndarray:
    """At most CODES codewords by Lloyd's steps from random members."""
    rng = np.random.default_rng(5)
    words = x[rng.permutation(len(x))[: min(CODES, max(1, len(x) // 4))]]
    for _ in range(12):
        step = max(1, CELLS // len(words))
        at = np.concatenate([np.argmin((words * words).sum(1) - 2 * (x[k : k + step] @ words.T), 1) for k in range(0, len(x), step)])
        n = np.bincount(at, minlength=len(words))
        sums = np.stack([np.bincount(at, x[:, d], len(words)) for d in range(x.shape[1])], 1)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _encoded(rows: DataFrame, centres: np.ndarray, words: np.ndarray) -> DataFrame:
    """id, hash, list, code and vector, packed, of every vector that can be indexed."""
    size = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = matrix(b.column(2), size)
            near = _nearest(unit(x), centres, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
            left = _pieces(_left(unit(x), centres, near)) if len(x) else np.zeros((0, len(words), PIECE))
            codes = np.stack([np.argmin((words[m] ** 2).sum(1) - 2 * (left[:, m] @ words[m].T), 1) for m in range(len(words))], 1).astype(np.uint8)
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(near.astype(np.int32)), packed(codes), packed(x.astype(np.float32))], ["id", "hash", "list", "code", "vector"])

    return rows.select("id", _hash().alias("hash"), "embedding").mapInArrow(run, "id long, hash long, list int, code binary, vector binary")


def temporary(chunks: DataFrame, lists: int = 0) -> AnnIndex:
    """An index of its own name in the shared folder."""
    from lectern.runtime import shared_folder

    return AnnIndex.build(chunks, f"{shared_folder(chunks.sparkSession)}/tables/{uuid.uuid4().hex}", lists)
