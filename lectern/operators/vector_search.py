"""Exact dense retrieval: nearest chunks, ranked papers and their evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.vectors import lengths, matrix, unit
from lectern.runtime import cut, ship

TOP_CHUNKS, TOP_PAPERS, EVIDENCE = 3, 5, 3
#: Digits that similarities of many questions are kept to, so that equal vectors tie.
ROUND = 9
EVIDENCE_FIELDS = ("chunk_id", "bucket", "section_index", "chunk_index", "path_string", "title", "sim")


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity in double precision, within [-1, 1]; null for a null, a zero vector or one of another length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = sum(float(x) * float(x) for x in query) ** 0.5
    good = (F.size(vector) == len(query)) & (norm > 0) & F.lit(length > 0)
    return F.when(good, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm * (length or 1.0)))))


def nearest_chunks(chunks: DataFrame, query: list[float], limit: int = TOP_CHUNKS) -> DataFrame:
    """The nearest chunks (id as chunk_id) with dist and sim; ties by chunk_id. A top-k, so each task sends ``limit`` rows."""
    scored = chunks.withColumn("sim", cosine(F.col("embedding"), query)).where("sim is not null").drop("embedding").withColumnRenamed("id", "chunk_id")
    return scored.withColumn("dist", 1 - F.col("sim")).orderBy("dist", "chunk_id").limit(limit)


#: Questions that are compared with all chunks in one pass, questions and chunks that a task compares at once.
BLOCK, ASKED_AT_ONCE, AT_ONCE = 8192, 1024, 512
#: Pairs of a question and chunks, of one in so many chunks at most, whose vectors are gathered to compare them in double precision, and how many at once.
FEW, PAIRS = 64, 1024


def nearest_in_blocks(chunks: DataFrame, queries: DataFrame, limit: int = TOP_CHUNKS) -> DataFrame:
    """(query_id, chunk_id, sim): the nearest chunks of many questions (query_id, vector), ties by chunk_id.

    Questions go in blocks of BLOCK, each a pass over the chunks; a task keeps ``limit``
    chunks of each question, and the best of those are chosen. Products in single precision
    rule out what their error bound keeps from the best; scores are of double precision. A question matches vectors of its
    own length; those that are null, zero or not whole match nothing. Questions with one id get
    the nearest of either.
    """
    spark = chunks.sparkSession
    ids = [r.query_id for r in queries.select("query_id").orderBy("query_id").toLocalIterator()]
    out = None
    for at in range(0, len(ids), BLOCK):
        rows = queries.where(F.col("query_id").between(ids[at], ids[min(at + BLOCK, len(ids)) - 1])).where("vector is not null")
        block = rows.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()  # one block
        found = _nearest_of_block(chunks, block, limit)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, chunk_id long, sim double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id"))
    return out.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def _nearest_of_block(chunks: DataFrame, block: pa.Table, limit: int) -> DataFrame:
    spark, sides = chunks.sparkSession, {}
    for part in block.to_batches():
        for n in np.unique(lengths(part.column(1))).tolist():
            at, x = matrix(part.column(1), n) if n > 0 else ([], None)
            if len(at):
                names, x = part.column(0).to_numpy()[at], unit(x)
                sides.setdefault(n, []).extend((names[k : k + ASKED_AT_ONCE], x[k : k + ASKED_AT_ONCE]) for k in range(0, len(x), ASKED_AT_ONCE))
    ship(spark)
    sent = spark.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sent.value
        single = {n: [questions.astype(np.float32) for _, questions in own] for n, own in sides.items()}
        held = {n: [(np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)) for names, _ in own] for n, own in sides.items()}
        for b in (whole.slice(k, AT_ONCE) for whole in batches for k in range(0, whole.num_rows, AT_ONCE)):
            for n, own in sides.items():
                at, x = matrix(b.column(1), n)
                if len(x):
                    ids = b.column(0).to_numpy()[at]
                    held[n] = [_nearer(*best, questions, less, x, ids, limit) for best, (_, questions), less in zip(held[n], own, single[n])]
        for n, own in sides.items():
            for (score, ids), (names, _) in zip(held[n], own):
                if ids.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel()), pa.array(-score.ravel())], ["query_id", "chunk_id", "sim"])

    vector = F.col("embedding")
    if chunks.schema["embedding"].dataType.simpleString() != "array<float>":  # tasks widen these themselves
        vector = vector.cast("array<double>")
    return chunks.select("id", vector.alias("embedding")).mapInArrow(run, "query_id long, chunk_id long, sim double")


def _nearer(score: np.ndarray, ids: np.ndarray, questions: np.ndarray, single: np.ndarray, x: np.ndarray, names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` best of each question so far, and of the vectors x; ``single`` holds the questions in single precision."""
    norm = np.sqrt((x * x).sum(1))
    compared = lambda q: np.round(-(q @ x.T) / norm, ROUND)
    if not limit or score.shape[1] < limit:
        return _best_of(score, ids, compared(questions), names, limit)
    # Unit vectors' products in single precision are off by less than a unit of the last place a dimension, however they are added.
    slack = (x.shape[1] + 16) * 2.0**-23 + 10.0**-ROUND
    edge = score[:, -1]
    row, at = np.nonzero(~(single @ (x / norm[:, None]).astype(np.float32).T < (-edge - slack).astype(np.float32)[:, None]))
    many = np.bincount(row, minlength=len(score)) > len(x) // FEW
    if many.any():
        score[many], ids[many] = _best_of(score[many], ids[many], compared(questions[many]), names, limit)
        row, at = row[~many[row]], at[~many[row]]
    new = np.empty(len(row))
    for k in range(0, len(row), PAIRS):
        r, a = row[k : k + PAIRS], at[k : k + PAIRS]
        new[k : k + PAIRS] = np.round(-np.einsum("ij,ij->i", questions[r], x[a]) / norm[a], ROUND)
    better = new <= edge[row]
    row, at, new = row[better], at[better], new[better]
    if len(row):
        hit = np.unique(row)
        rows = np.concatenate([np.repeat(hit, limit), row])
        scores, known = np.concatenate([score[hit].ravel(), new]), np.concatenate([ids[hit].ravel(), names[at]])
        order = np.lexsort((known, scores, rows))
        order = order[np.searchsorted(rows[order], hit)[:, None] + np.arange(limit)]
        score[hit], ids[hit] = scores[order], known[order]
    return score, ids


def _best_of(score: np.ndarray, ids: np.ndarray, new: np.ndarray, names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` least of each row of score and new, ties by id: only what is not above a row's limit-th least is sorted."""
    score, ids = np.concatenate([score, new], 1), np.concatenate([ids, np.broadcast_to(names, new.shape)], 1)
    keep = min(limit, score.shape[1])
    if not keep:
        return score[:, :0], ids[:, :0]
    row, at = np.nonzero(score <= np.partition(score, keep - 1, 1)[:, keep - 1 : keep])
    order = np.lexsort((ids[row, at], score[row, at], row))
    first = np.searchsorted(row, np.arange(len(score)))  # rows are in order before and after
    order = order[first[:, None] + np.arange(keep)]
    return score[row[order], at[order]], ids[row[order], at[order]]


def paper_scores(candidates: DataFrame, limit: int = TOP_PAPERS) -> DataFrame:
    """(paper_id, paper_score, paper_rank) of the papers with the best chunks; ties by paper_id."""
    best = candidates.groupBy("paper_id").agg(F.max("sim").alias("paper_score")).orderBy(F.desc("paper_score"), "paper_id").limit(limit)
    return best.withColumn("paper_rank", F.row_number().over(Window.orderBy(F.desc("paper_score"), "paper_id")))  # at most ``limit`` rows


def paper_titles(chunks: DataFrame, paper_ids: DataFrame) -> DataFrame:
    """(paper_id, paper_title): the title of each paper's abstract, else of its first chunk with a title."""
    rows = chunks.where("title is not null").join(paper_ids, "paper_id", "left_semi")  # Spark broadcasts few ids by their size
    first = F.struct(F.col("bucket") != "abstract", F.col("section_index"), F.col("chunk_index"), F.col("title"))
    return rows.groupBy("paper_id").agg(F.min_by("title", first).alias("paper_title"))


def ranked_evidence(candidates: DataFrame) -> DataFrame:
    """Candidates with ev_rank inside their paper, the most similar first."""
    return candidates.withColumn("ev_rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("sim"), "chunk_id")))


def retrieve(chunks: DataFrame, query: list[float], top_chunks: int = TOP_CHUNKS, top_papers: int = TOP_PAPERS, evidence: int = EVIDENCE) -> DataFrame:
    """(paper_rank, paper_id, paper_title, paper_score, evidence): ranked papers with their best chunks nested.

    evidence is null where the limit on it lets none through.
    """
    candidates = cut(nearest_chunks(chunks, query, top_chunks))
    top = paper_scores(candidates, top_papers)
    titles = paper_titles(chunks, candidates.select("paper_id").distinct())
    fields = [F.col(c) for c in EVIDENCE_FIELDS] + [F.col("chunk_text").alias("text")]
    shown = ranked_evidence(candidates).where(F.col("ev_rank") <= evidence)
    listed = shown.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ev_rank", F.struct(*fields).alias("item")))).alias("ranked"))
    listed = listed.select("paper_id", F.transform("ranked", lambda x: x["item"]).alias("evidence"))
    out = top.join(F.broadcast(titles), "paper_id", "left").join(F.broadcast(listed), "paper_id", "left")
    return out.select("paper_rank", "paper_id", "paper_title", "paper_score", "evidence").orderBy("paper_rank")


def flat_evidence(retrieved: DataFrame) -> DataFrame:
    """One row for each chunk of evidence."""
    return retrieved.select("paper_rank", "paper_id", "paper_title", "paper_score", F.posexplode("evidence").alias("at", "e")).select(
        "paper_rank", "paper_id", "paper_title", "paper_score", (F.col("at") + 1).alias("ev_rank"), "e.*"
    )
