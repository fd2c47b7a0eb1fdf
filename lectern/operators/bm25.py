"""BM25 over chunks: one question straight over the texts, or many over an inverted index on disk.

A chunk's score is a sum over the question's terms in order, in decimals, so equal chunks
have equal scores wherever their rows are, and ties go to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lectern.functions.text import IS_WORD, STOP_WORDS, spaced_words, tokens
from lectern.runtime import bound_batches, cut

# The usual parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Digits that scores are kept to, and the type their parts are added in.
DIGITS, EXACT = 9, "decimal(28,12)"
#: Folders that an index's postings are dealt to by a hash of their term.
BUCKETS = 64
#: Chunks of a group whose postings of a folder go to one task, about.
DEALT = 100_000
#: Bytes of words whose postings are put together at once.
PACK_BYTES = 1 << 23


@dataclass
class Index:
    """postings (term, chunk_id, tf, dl), terms (term, df) and size: one row of n, avgdl and mean (of all inverse frequencies).

    words, of an index that is not from disk: (chunk_id, words) of all chunks.
    """

    postings: DataFrame
    terms: DataFrame
    size: DataFrame
    words: DataFrame | None = None


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _mean(terms: DataFrame, size: DataFrame) -> DataFrame:
    """size with the mean inverse frequency over the whole vocabulary."""
    idf = F.sum(F.round(inverse_frequency(F.col("n"), F.col("df")), 12).cast("decimal(28,12)")) / F.count("*")
    return size.crossJoin(F.broadcast(terms.crossJoin(F.broadcast(size)).agg(idf.cast("double").alias("mean"))))  # one row each


def index(chunks: DataFrame, text: str = "chunk_text", key: str = "chunk_id") -> Index:
    """The index of chunks; write_index keeps it for many questions."""
    rows = chunks.select(F.col(key).alias("chunk_id"), tokens(F.col(text)).alias("words"))
    postings = rows.select("chunk_id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, terms, _mean(terms, _lengths(postings, "tf", chunks.agg(F.count("*").alias("n")))), rows)


#: What packed() makes of a batch: a term's chunks, how often each has it, how long each is, the number of chunks and of words.
PACKED = "term string, chunk_ids array<{key}>, tfs array<int>, dls array<int>, df int, words long"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of PACK_BYTES, about."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PACK_BYTES:
            whole, held, size = pa.concat_batches(held), [], 0
            yield whole
            pa.default_memory_pool().release_unused()  # else a worker grows with the number of batches
    if held:
        yield pa.concat_batches(held)


def by_term(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, ends, row, tf, dl) of a batch's lists of words: between its two ends, the rows that have a term and how often; and each row's length."""
    n = len(lists)
    dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = pc.dictionary_encode(lists.flatten())
    cells = coded.indices.to_numpy().astype(np.int64)
    cells *= n
    cells += np.repeat(np.arange(n, dtype=np.int32), dl)
    cells, tf = np.unique(cells, return_counts=True)
    term, row = np.divmod(cells, max(1, n))
    ends = np.searchsorted(term, np.arange(len(coded.dictionary) + 1)).astype(np.int32)
    return coded.dictionary, ends, row, tf.astype(np.int32), dl


def packed(words: DataFrame) -> DataFrame:
    """Postings of (chunk_id, words), those of a term together as far as a batch of chunks goes; chunk ids are distinct.

    Counting needs no shuffle, and a term travels once a batch instead of once a chunk.
    """
    bound_batches(words.sparkSession)

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        terms, ends, row, tf, dl = by_term(b.column(1))
        sums = np.diff(np.concatenate([[0], np.cumsum(tf, dtype=np.int64)])[ends])
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (b.column(0).take(pa.array(row)), pa.array(tf), pa.array(dl[row]))]
        return pa.RecordBatch.from_arrays([terms, *lists, pa.array(np.diff(ends)), pa.array(sums)], ["term", "chunk_ids", "tfs", "dls", "df", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            yield pack(b)

    return words.select("chunk_id", "words").mapInArrow(run, PACKED.format(key=words.schema["chunk_id"].dataType.simpleString()))


def _single(postings: DataFrame) -> DataFrame:
    """Counted postings as packed() rows of one chunk each."""
    return postings.select("term", F.array("chunk_id").alias("chunk_ids"), F.array(F.col("tf").cast("int")).alias("tfs"), F.array("dl").alias("dls"), F.lit(1).alias("df"), F.col("tf").alias("words"))


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """packed() rows of n chunks, dealt by folder and by groups of chunks: a task gets few folders, and a term of many chunks is shared by tasks."""
    part = F.pmod(F.xxhash64(F.get("chunk_ids", F.lit(0))), F.lit(1 + n // DEALT))
    return rows.repartition(_bucket(F.col("term")), part)


def _flat(rows: DataFrame, bucket: Column) -> DataFrame:
    """Postings of packed() rows, with their bucket."""
    flat = rows.select("term", bucket.alias("bucket"), F.explode(F.arrays_zip("chunk_ids", "tfs", "dls")).alias("p"))
    return flat.select("term", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"), "bucket")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """packed() rows of n chunks, dealt by _spread(), as postings in order with their bucket."""
    return _flat(_spread(rows, n), _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "chunk_id")


def _lengths(table: DataFrame, column: str, count: DataFrame) -> DataFrame:
    """One row of n and avgdl, from the number of all chunks and a column whose sum is the number of words."""
    words = table.agg(F.coalesce(F.sum(column), F.lit(0)).alias("words"))
    return count.crossJoin(F.broadcast(words)).select("n", F.try_divide(F.col("words").cast("double"), F.col("n")).alias("avgdl"))  # one row each


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(made: Index, path: str) -> None:
    """The index as Parquet: postings and terms in folders by a hash of the term, so that a question reads those of its terms only.

    Texts are cut into words once. Postings are packed by batches of chunks, so they need no counting
    shuffle and stay packed on disk; the terms come from the packed rows' own sums, and the size from
    the terms. Ids that stand twice, or are null, have their postings counted by a shuffle instead.
    """
    spark = made.words.sparkSession
    seen = made.words.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids")).first()
    rows = packed(made.words) if seen["n"] == seen["ids"] else _single(made.postings)
    order = ["bucket", "term"]
    _spread(rows, seen["n"]).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/columns")  # an index without words has no other file that tells them
    terms = _kept(spark, path).repartition("bucket").groupBy(*order).agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    terms.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/terms")
    kept, count = _terms(spark, path), spark.range(1).select(F.lit(seen["n"]).cast("long").alias("n"))
    _mean(kept, _lengths(kept, "words", count)).write.parquet(f"{path}/size")


def _kept(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("bucket", IntegerType())).parquet(f"{path}/postings")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    kept = _kept(spark, path)
    return _flat(kept, F.col("bucket")) if "chunk_ids" in kept.columns else kept  # indexes were kept as single postings before


def _terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df long, words long, bucket int").parquet(f"{path}/terms")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(_postings(spark, path), _terms(spark, path), spark.read.parquet(f"{path}/size"))


def asked_terms(spark: SparkSession, query: str) -> list[tuple[str, int]]:
    """(term, times) of a question, in order."""
    rows = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").count().orderBy("term").collect()  # the words of one question
    return [(r.term, r["count"]) for r in rows]


def _of_terms(table: DataFrame, names: list[str]) -> DataFrame:
    """Rows of some terms, from their folders alone if the table has them."""
    found = table.where(F.col("term").isin(names))
    if "bucket" not in table.columns:
        return found
    spark = table.sparkSession
    buckets = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("t")).select(_bucket(F.col("t")).alias("b")).distinct().collect()  # a question's terms
    return found.where(F.col("bucket").isin([r.b for r in buckets]))


def _part(times, idf, tf, dl, avgdl) -> Column:
    """What a term adds to a chunk's score."""
    return F.round(times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), 12).cast(EXACT)


def _weighed(terms: DataFrame, size: DataFrame) -> DataFrame:
    """terms with n, avgdl and idf, a negative one made EPSILON times the mean."""
    idf = inverse_frequency(F.col("n"), F.col("df"))
    return terms.crossJoin(F.broadcast(size)).withColumn("idf", F.when(idf < 0, EPSILON * F.col("mean")).otherwise(idf))  # one row


def scores(found: Index, query: str) -> DataFrame:
    """(chunk_id, score, n_chunks) of the chunks with a term of the question.

    A negative inverse frequency becomes EPSILON times the mean over the whole vocabulary;
    repeated question terms count each time; unknown terms add nothing.
    """
    spark = found.postings.sparkSession
    asked = asked_terms(spark, query)
    names = [t for t, _ in asked]
    times = F.coalesce(*[F.when(F.col("term") == t, F.lit(k)) for t, k in asked], F.lit(0))
    wanted = _weighed(_of_terms(found.terms, names).select("term", "df"), found.size).select("term", "n", "avgdl", "idf")
    matched = _of_terms(found.postings, names).join(F.broadcast(wanted), "term")  # a question's terms
    part = _part(times, F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return matched.groupBy("chunk_id").agg(F.sum(part).alias("score"), F.max("n").alias("n_chunks")).select("chunk_id", F.round(F.col("score").cast("double"), DIGITS).alias("score"), "n_chunks")


def scores_of_texts(chunks: DataFrame, query: str, text: str = "chunk_text", key: str = "chunk_id") -> DataFrame:
    """The same for a single question without an index: only the vocabulary and the question's terms are aggregated."""
    spark = chunks.sparkSession
    asked = asked_terms(spark, query)
    words = chunks.select(F.col(key).alias("chunk_id"), spaced_words(F.col(text)).alias("words"))
    is_term = ~F.col("term").isin(*STOP_WORDS) & F.rlike("term", F.lit(IS_WORD))
    terms = words.select(F.explode(F.array_distinct("words")).alias("term")).where(is_term).groupBy("term").agg(F.count("*").alias("df"))
    tf = [F.count_if(F.col("term") == t).alias(f"tf{k}") for k, (t, _) in enumerate(asked)]
    counted = words.select("chunk_id", F.explode_outer("words").alias("term")).withColumn("term", F.when(is_term, F.col("term")))
    counted = counted.groupBy("chunk_id").agg(F.count("term").alias("dl"), *tf)
    size = _mean(terms, counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    weighed = _weighed(terms.where(F.col("term").isin([t for t, _ in asked])), size)
    first = lambda c, t: F.max(F.when(F.col("term") == t, F.col(c)))
    one = weighed.agg(F.max("n").alias("n_chunks"), F.max("avgdl").alias("avgdl"), *[first("idf", t).alias(f"idf{k}") for k, (t, _) in enumerate(asked)])
    total = F.lit(0).cast(EXACT)
    for k, (_, times) in enumerate(asked):
        part = _part(F.lit(times), F.col(f"idf{k}"), F.col(f"tf{k}"), F.col("dl"), F.col("avgdl"))
        total = (total + F.when(F.col(f"tf{k}") > 0, part).otherwise(F.lit(0).cast(EXACT))).cast(EXACT)
    has_term = F.greatest(*[F.col(f"tf{k}") for k in range(len(asked))], F.lit(0), F.lit(0)) > 0
    return counted.where(has_term).crossJoin(F.broadcast(one)).select("chunk_id", F.round(total.cast("double"), DIGITS).alias("score"), "n_chunks")


def hits(scored: DataFrame) -> DataFrame:
    """Scored chunks that a descending walk meets before the first score of exactly 0.

    Chunks that are not in ``scored`` have that score, so one is met as soon as any is left out.
    """
    zero = scored.agg((F.coalesce(F.max("n_chunks") > F.count("*"), F.lit(True)) | F.coalesce(F.bool_or(F.col("score") == 0), F.lit(False))).alias("zero"))
    return scored.crossJoin(F.broadcast(zero)).where((F.col("score") > 0) | ((F.col("score") < 0) & ~F.col("zero"))).drop("zero", "n_chunks")  # one row


def top_papers(chunks: DataFrame, scored: DataFrame, papers: int = 5, evidence: int = 3) -> DataFrame:
    """(paper_rank, paper_id, paper_title, paper_score, evidence, evidence_ids): best papers with their best chunks' texts.

    chunks: chunk_id, paper_id, title and chunk_text. A paper's score and title are those of
    its best chunk; ties go to the smaller chunk_id.
    """
    rows = cut(hits(cut(scored)).join(chunks.select("chunk_id", "paper_id", "title"), "chunk_id"))  # scored once, met once
    order = F.struct(-F.col("score"), F.col("chunk_id"))
    best = rows.groupBy("paper_id").agg(F.max("score").alias("paper_score"), F.min_by("title", order).alias("paper_title"), F.min(order).alias("order"))
    best = best.orderBy("order").limit(papers)
    best = best.withColumn("paper_rank", F.row_number().over(Window.orderBy("order"))).drop("order")  # at most ``papers`` rows
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "chunk_id"))
    shown = rows.join(F.broadcast(best.select("paper_id")), "paper_id", "left_semi").withColumn("nth", nth).where(F.col("nth") <= evidence)
    shown = chunks.select("chunk_id", "chunk_text").join(F.broadcast(shown.select("chunk_id", "paper_id", "nth")), "chunk_id")  # papers times evidence rows
    listed = shown.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("nth", "chunk_text", "chunk_id"))).alias("e"))
    listed = listed.select("paper_id", F.transform("e", lambda x: x["chunk_text"]).alias("evidence"), F.transform("e", lambda x: x["chunk_id"]).alias("evidence_ids"))
    return best.join(F.broadcast(listed), "paper_id").select("paper_rank", "paper_id", "paper_title", "paper_score", "evidence", "evidence_ids").orderBy("paper_rank")
