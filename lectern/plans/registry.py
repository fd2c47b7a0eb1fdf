"""Every query outside the llm subpackage, with its DuckDB oracle.

The driver's tables stand in for papers: embeddings and documents give chunks (label and
source play the paper), lines of documents play sections.
"""

from __future__ import annotations

import random
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as T
from lectern.operators import ann, bm25, chunking, embedding, lexical, lsa, rag, sampling, sections, upsert, vector_search
from lectern.runtime import discard, load, shared_folder, written
from lectern.sources import corpus, filelist, jats

QUESTION = "the hation thing of trash nd ores the onea is token"
TOP_CHUNKS, TOP_PAPERS, EVIDENCE = 40, 5, 3

_BUCKET_CASE = "CASE {0} % 5 WHEN 0 THEN 'abstract' WHEN 1 THEN 'introduction' WHEN 2 THEN 'methods' WHEN 3 THEN 'results' ELSE 'discussion' END"


def _vector_chunk_columns(cast: str) -> list[str]:
    return [
        "vec_id AS id", f"concat('p', CAST(label AS {cast})) AS paper_id", f"{_BUCKET_CASE.format('vec_id')} AS bucket",
        "CAST(vec_id % 7 - 1 AS INT) AS section_index", "CAST(vec_id % 3 AS INT) AS chunk_index", f"concat('part ', CAST(vec_id % 7 AS {cast})) AS path_string",
        f"CASE WHEN vec_id % 4 = 0 THEN NULL ELSE concat('Title ', CAST(label AS {cast}), '/', CAST(vec_id % 11 AS {cast})) END AS title",
        f"concat('chunk ', CAST(vec_id AS {cast})) AS chunk_text", "embedding",
    ]


def _document_chunk_columns(cast: str) -> list[str]:
    return [
        "doc_id AS chunk_id", "source AS paper_id", f"{_BUCKET_CASE.format('doc_id')} AS bucket", "CAST(doc_id % 7 - 1 AS INT) AS section_index",
        "CAST(doc_id % 3 AS INT) AS chunk_index", f"concat('path ', CAST(doc_id % 5 AS {cast})) AS path_string",
        f"CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('Doc ', CAST(doc_id AS {cast})) END AS title", "text AS chunk_text",
    ]


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").selectExpr(*_vector_chunk_columns("string"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr(*_document_chunk_columns("string"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = load(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row.embedding) if row else [0.0]


_V = f"chunks AS (SELECT {', '.join(_vector_chunk_columns('VARCHAR'))} FROM embeddings)"
_SCORED = f"""{_V},
query AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
candidates AS (
  SELECT id AS chunk_id, * EXCLUDE (id, embedding, q), list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS sim
  FROM chunks, query ORDER BY sim DESC, chunk_id LIMIT {TOP_CHUNKS})"""
_RANKED = f"""{_SCORED},
top_papers AS (
  SELECT *, row_number() OVER (ORDER BY paper_score DESC, paper_id) AS paper_rank
  FROM (SELECT paper_id, max(sim) AS paper_score FROM candidates GROUP BY paper_id ORDER BY paper_score DESC, paper_id LIMIT {TOP_PAPERS}))"""
_RETRIEVED = f"""{_RANKED},
titles AS (
  SELECT DISTINCT ON (paper_id) paper_id, title AS paper_title FROM chunks WHERE title IS NOT NULL
  ORDER BY paper_id, (bucket <> 'abstract'), section_index, chunk_index, title),
evidence AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY sim DESC, chunk_id) AS ev_rank FROM candidates),
retrieved AS (
  SELECT t.paper_rank, t.paper_id, m.paper_title, t.paper_score, e.* EXCLUDE (paper_id)
  FROM top_papers t LEFT JOIN titles m USING (paper_id) JOIN evidence e USING (paper_id) WHERE ev_rank <= {EVIDENCE})"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_SCORED} SELECT chunk_id, paper_id, round(sim, 6) AS sim, round(1 - sim, 6) AS dist FROM candidates")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector_search.nearest_chunks(vector_chunks(spark, sf_dir), query_vector(spark, sf_dir), TOP_CHUNKS)
    return near.select("chunk_id", "paper_id", F.round("sim", 6).alias("sim"), F.round("dist", 6).alias("dist"))


@query(
    f"""WITH {_V}, asked AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
scored AS (
  SELECT query_id, id AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS sim FROM chunks, asked)
SELECT query_id, chunk_id, round(sim, 6) AS sim FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= {EVIDENCE * TOP_PAPERS}"""
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 is a question to all vectors."""
    asked = load(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_search.nearest_in_blocks(vector_chunks(spark, sf_dir), asked, EVIDENCE * TOP_PAPERS)
    return found.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def trained_vectors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors trained on all documents; the nearest of all documents to each whose id is divisible by 100."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = written(lsa.counted(docs))
    vectors = written(lsa.vectors(rows, lsa.fit_counted(rows)))
    discard(rows)
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vector_search.nearest_in_blocks(vectors, asked, EVIDENCE * TOP_PAPERS)
    return found.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"))


@query(ORACLES["vector_topk_batch"])
def ann_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over all vectors, asked with every vector whose id is divisible by 100, in all of its lists."""
    found = ann.temporary(vector_chunks(spark, sf_dir)).exact(_asked(spark, sf_dir), EVIDENCE * TOP_PAPERS)
    return found.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions by codes, in the lists and with the candidates that the index chose for itself."""
    found = ann.temporary(vector_chunks(spark, sf_dir)).search(_asked(spark, sf_dir), EVIDENCE * TOP_PAPERS)
    return found.select("query_id", "chunk_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {_RANKED} SELECT paper_rank, paper_id, round(paper_score, 6) AS paper_score FROM top_papers")
def paper_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector_search.nearest_chunks(vector_chunks(spark, sf_dir), query_vector(spark, sf_dir), TOP_CHUNKS)
    return vector_search.paper_scores(near, TOP_PAPERS).select(F.col("paper_rank").cast("long").alias("paper_rank"), "paper_id", F.round("paper_score", 6).alias("paper_score"))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.retrieve(vector_chunks(spark, sf_dir), query_vector(spark, sf_dir), TOP_CHUNKS, TOP_PAPERS, EVIDENCE)


@query(
    f"""WITH {_RETRIEVED}
SELECT paper_rank, paper_id, paper_title, round(paper_score, 6) AS paper_score, ev_rank, chunk_id, bucket, section_index, chunk_index, path_string, title,
       round(sim, 6) AS sim, chunk_text AS text FROM retrieved"""
)
def paper_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = vector_search.flat_evidence(_retrieved(spark, sf_dir))
    for c in ("paper_score", "sim"):
        flat = flat.withColumn(c, F.round(c, 6))
    return flat.withColumn("paper_rank", F.col("paper_rank").cast("long")).withColumn("ev_rank", F.col("ev_rank").cast("long"))


@query(
    f"""WITH chunks AS (SELECT {", ".join(_document_chunk_columns("VARCHAR"))} FROM documents)
SELECT DISTINCT ON (paper_id) paper_id, title AS paper_title FROM chunks WHERE title IS NOT NULL
ORDER BY paper_id, (bucket <> 'abstract'), section_index, chunk_index, title"""
)
def distinct_on_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = document_chunks(spark, sf_dir)
    return vector_search.paper_titles(chunks, chunks.select("paper_id").distinct())


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tokens_sql(text: str) -> str:
    spaced = f"""regexp_replace(lower(coalesce({text}, '')), '[,;:?!()\\[\\]{{}}<>"@#$%&]|--', ' ', 'g')"""
    parted = f"""regexp_replace({spaced}, '(n''t|''(?:s|m|d|ll|re|ve))(\\s|$)', ' \\1\\2', 'g')"""
    return f"""list_filter(list_transform(regexp_split_to_array({parted}, '\\s+'), lambda w: regexp_replace(w, '\\.$', '')),
       lambda w: regexp_full_match(w, '\\p{{L}}+') AND NOT list_contains([{_STOP}], w))"""


_BM25 = f"""chunks AS (SELECT {", ".join(_document_chunk_columns("VARCHAR"))} FROM documents),
rows_ AS (SELECT chunk_id, {_tokens_sql("chunk_text")} AS terms FROM chunks),
postings AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM rows_) GROUP BY ALL),
lengths AS (SELECT chunk_id, len(terms) AS dl FROM rows_),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
freq AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), size),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest({_tokens_sql(f"'{QUESTION}'")}) AS term) GROUP BY term),
wanted AS (SELECT term, times, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM freq) ELSE idf END AS idf FROM freq JOIN asked USING (term)),
summed AS (
  SELECT chunk_id, round(CAST(sum(CAST(round(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 12) AS DECIMAL(28, 12))) AS DOUBLE), 9) AS score
  FROM postings JOIN wanted USING (term) JOIN lengths USING (chunk_id), size GROUP BY chunk_id),
scored AS (SELECT chunk_id, coalesce(score, 0.0) AS score FROM lengths LEFT JOIN summed USING (chunk_id)),
hits AS (SELECT * FROM scored WHERE score > 0 OR (score < 0 AND NOT (SELECT bool_or(score = 0) FROM scored)))"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = document_chunks(spark, sf_dir)
    return chunks, bm25.scores_of_texts(chunks, QUESTION)


@query(f"WITH {_BM25} SELECT chunk_id, round(score, 6) AS score FROM hits")
def bm25_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.hits(_scored(spark, sf_dir)[1]).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT chunk_id, round(score, 6) AS score FROM hits")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores through an index on disk, whose question reads the folders of its terms only."""
    path = _shared_path(spark)
    bm25.write_index(bm25.index(document_chunks(spark, sf_dir)), path)
    return bm25.hits(bm25.scores(bm25.open_index(spark, path), QUESTION)).select("chunk_id", F.round("score", 6).alias("score"))


@query(ORACLES["bm25_index"])
def lexical_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores through an index that had every second chunk with another text and one chunk too many a text, and followed."""
    chunks = document_chunks(spark, sf_dir).select("chunk_id", "chunk_text")
    found = lexical.LexicalIndex(spark, _shared_path(spark))
    older = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("older thing ores "), F.coalesce("chunk_text", F.lit("")))).otherwise(F.col("chunk_text"))
    found.upsert(chunks.withColumn("chunk_text", older).unionByName(chunks.withColumn("chunk_id", -1 - F.col("chunk_id"))))
    found.upsert(chunks)
    found.delete(chunks.select((-1 - F.col("chunk_id")).alias("chunk_id")))
    return bm25.hits(bm25.scores(found.open(), QUESTION)).select("chunk_id", F.round("score", 6).alias("score"))


_BM25_PAPERS = f"""{_BM25},
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_id) AS nth FROM hits JOIN chunks USING (chunk_id)),
papers AS (
  SELECT paper_id, title AS paper_title, score AS paper_score, row_number() OVER (ORDER BY score DESC, chunk_id) AS paper_rank FROM ranked
  WHERE nth = 1 QUALIFY paper_rank <= {TOP_PAPERS})"""


@query(
    f"""WITH {_BM25_PAPERS}
SELECT paper_rank, p.paper_id, paper_title, round(paper_score, 6) AS paper_score, nth, chunk_id, chunk_text FROM papers p JOIN ranked r USING (paper_id) WHERE nth <= {EVIDENCE}"""
)
def bm25_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = bm25.top_papers(*_scored(spark, sf_dir), TOP_PAPERS, EVIDENCE)
    rows = top.select("paper_rank", "paper_id", "paper_title", "paper_score", F.posexplode(F.arrays_zip("evidence", "evidence_ids")).alias("at", "e"))
    return rows.select(
        F.col("paper_rank").cast("long").alias("paper_rank"), "paper_id", "paper_title", F.round("paper_score", 6).alias("paper_score"),
        (F.col("at") + 1).cast("long").alias("nth"), F.col("e.evidence_ids").alias("chunk_id"), F.col("e.evidence").alias("chunk_text"),
    )


@query(
    f"""WITH {_RETRIEVED.replace("chunks AS (", "vchunks AS (").replace("FROM chunks", "FROM vchunks")}, {_BM25_PAPERS.replace("titles", "btitles")},
sources AS (
  SELECT 0 AS source, paper_rank, ev_rank AS nth, paper_id, paper_title, path_string, chunk_text FROM retrieved
  UNION ALL SELECT 1, paper_rank, nth, p.paper_id, paper_title, path_string, chunk_text FROM papers p JOIN ranked r USING (paper_id) WHERE nth <= {EVIDENCE}),
numbered AS (SELECT *, row_number() OVER (ORDER BY source, paper_rank, nth) AS n FROM sources)
SELECT n, '[S:' || n || '] Paper: ' || paper_id || ' - ' || coalesce(paper_title, 'None') || ' - ' || path_string || chr(10) || chunk_text || chr(10) || chr(10) AS block FROM numbered"""
)
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, scored = _scored(spark, sf_dir)
    lexical = rag.lexical_sources(bm25.top_papers(chunks, scored, TOP_PAPERS, EVIDENCE), chunks.select("chunk_id", "path_string"))
    found = rag.numbered(rag.dense_sources(_retrieved(spark, sf_dir)).unionByName(lexical))
    return found.select(F.col("n").cast("long").alias("n"), "block")


#: Unicode white space for RE2, whose own class is ASCII.
_RE2_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _normal_sql(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{_RE2_SPACE}+', ' ', 'g'))"


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(string_split({_normal_sql("text")}, ' '), lambda x: x <> '') AS words FROM documents),
k AS (SELECT doc_id, words, unnest(CASE WHEN len(words) = 0 THEN [] ELSE generate_series(0, CAST(ceil(greatest(len(words) - 348, 0) / 278.0) AS BIGINT)) END) AS k FROM w)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, array_to_string(list_slice(words, k * 278 + 1, k * 278 + 348), ' ') AS chunk_text FROM k"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.word_windows(F.col("text"))).alias("chunk_index", "chunk_text"))


@query(
    """WITH d AS (SELECT source AS paper_id, CAST(doc_id AS BIGINT) AS section_index, min(lang) AS bucket FROM documents GROUP BY ALL),
old AS (SELECT paper_id, section_index, unnest([0, 2]) AS chunk_index, bucket FROM d),
new AS (SELECT paper_id, section_index, unnest([0, 1]) AS chunk_index, 'new ' || section_index AS bucket FROM d)
SELECT paper_id, section_index, chunk_index, coalesce(n.bucket, o.bucket) AS bucket, o.id AS old_id
FROM (SELECT *, section_index * 3 + chunk_index AS id FROM old) o FULL JOIN new n USING (paper_id, section_index, chunk_index)"""
)
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert with every document on both sides: a key of its own that changes, one that stays and one that is new."""
    key = ["paper_id", "section_index", "chunk_index"]
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").cast("long").alias("section_index"), F.col("lang").alias("bucket"))
    docs = docs.groupBy("paper_id", "section_index").agg(F.min("bucket").alias("bucket"))
    row_id = (F.col("section_index") * 3 + F.col("chunk_index")).alias("id")
    old = docs.withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(2)))).select(*key, row_id, "bucket")
    new = docs.withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1)))).select(*key, F.concat(F.lit("new "), "section_index").alias("bucket"), F.col("section_index").alias("seq"))
    twice = upsert.merged(upsert.merged(old, new), new)  # the same batch again changes nothing
    known = old.select(*key, F.col("id").alias("old_id"))
    return twice.join(known, key, "left").select(*key, "bucket", "old_id")


TITLES = (
    "Results and Discussion", "Discussion and Conclusions", "Methods and Results", "Methods, Results and Discussion", "Result", "Statistical analysis",
    "Ethics approval", "1. Introduction", "I) Methods", "Section 2: Results", "T-cell assays", "Cohort", "", "Materials and  Methods", "iv. Findings", "2.1.3 Outcomes",
    "A. Patients and methods", "Data availability", "Measures", "Survey endpoints", "Related work", "Concluding words", "(3) Summary", "Chapter 4 - Interpretation",
    "Author contributions and methods", "Final remarks", "Study design", "Background", "Variables of the survey", "Mid-term resultsets", "Publisher notes",
)
# A title for each document, some with the name of its source or language behind.
_TITLES_SQL = f"""titles AS (
  SELECT doc_id, [{", ".join(f"'{t}'" for t in TITLES)}][doc_id % {len(TITLES)} + 1] || CASE doc_id % 3 WHEN 1 THEN ' ' || coalesce(source, '') WHEN 2 THEN ' ' || coalesce(lang, '') ELSE '' END AS title
  FROM documents)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, name = F.col("doc_id"), F.get(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES)).cast("int"))
    behind = lambda c: F.concat(F.lit(" "), F.coalesce(c, F.lit("")))
    more = F.when(n % 3 == 1, behind("source")).when(n % 3 == 2, behind("lang")).otherwise("")
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(name, more).alias("title"))


def _normal_title_sql(title: str) -> str:
    label = "(?i)" + T.LABEL
    return _normal_sql(f"regexp_replace(regexp_replace(trim(lower({title})), '{label}', ''), '[^a-z0-9\\s]+', ' ', 'g')")


def _strong_sql(n: str) -> str:
    admin = " OR ".join(f"contains({n}, '{p.replace(chr(39), chr(39) * 2)}')" for p in T.ADMIN_PARTS)
    both = " ".join(f"WHEN contains({n}, '{a}') AND contains({n}, '{b}') THEN '{c}'" for a, b, c in T.COMBINED)
    each = " ".join(f"WHEN regexp_matches({n}, '\\b(?:{T.STRONG[b]})\\b') THEN '{b}'" for b in T.PRIORITY)
    return f"CASE WHEN {n} = '' OR {admin} THEN NULL {both} {each} END"


def _admin_sql(n: str) -> str:
    return "(" + " OR ".join(f"contains({n}, '{p.replace(chr(39), chr(39) * 2)}')" for p in T.ADMIN_PARTS) + ")"


def _weak_sql(n: str, strong: str) -> str:
    return f"CASE WHEN {n} <> '' AND NOT {_admin_sql(n)} AND {strong} IS NULL AND regexp_matches({n}, '\\b(?:{T.WEAK_METHODS})\\b') THEN 'methods' END"


@query(f"WITH {_TITLES_SQL} SELECT doc_id, title, {_normal_title_sql('title')} AS normalized FROM titles")
def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", "title", T.normalize_title(F.col("title")).alias("normalized"))


@query(f"WITH {_TITLES_SQL} SELECT doc_id, title, {_normal_sql(f'regexp_replace(title, {chr(39)}(?i){T.LABEL}{chr(39)}, {chr(39) * 2})')} AS cleaned FROM titles")
def path_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", "title", T.clean_path_title(F.col("title")).alias("cleaned"))


@query(f"WITH {_TITLES_SQL}, n AS (SELECT doc_id, title, {_normal_title_sql('title')} AS n FROM titles), s AS (SELECT *, {_strong_sql('n')} AS strong FROM n) SELECT doc_id, title, strong, {_weak_sql('n', 'strong')} AS weak, {_admin_sql('n')} AS admin FROM s")
def title_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", "title", T.title_marks(F.col("title")).alias("m")).select("doc_id", "title", "m.*")


_SECTION_TITLES = ("Introduction", "Cohort", "2. Methods", "Statistical analysis", "Funding", "Results and discussion", "Details", "Conclusions")
_TITLE_OF = "CASE k % 9 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_SECTION_TITLES)) + " END"
# Every third section hangs below the one before; the others stand at depth 0.
_SECTIONS_SQL = f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
flat AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS k, a FROM lines),
raw AS (SELECT doc_id, k, CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END AS depth, {_TITLE_OF} AS title, a[k + 1] AS text FROM flat),
norm AS (SELECT *, {_normal_title_sql("coalesce(title, '')")} AS n FROM raw),
marked AS (SELECT *, {_strong_sql("n")} AS strong, {_admin_sql("n")} AS admin FROM norm),
weak AS (SELECT *, {_weak_sql("n", "strong")} AS weak FROM marked),
top AS (SELECT *, coalesce(strong, weak, CASE WHEN NOT admin THEN last_value(strong IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, title, 'untitled') AS bucket
  FROM weak WHERE depth = 0),
named AS (
  SELECT r.doc_id, r.k, r.depth, r.title, r.text, CASE WHEN r.depth = 0 THEN t.bucket ELSE coalesce(r.strong, t.bucket) END AS bucket,
         array_to_string(list_filter([CASE WHEN r.depth = 1 THEN t.title END, r.title], lambda x: x IS NOT NULL), ' > ') AS path_raw
  FROM weak r JOIN top t ON t.doc_id = r.doc_id AND t.k = r.k - r.depth),
sections AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, path_raw, text ORDER BY k) AS nth FROM named WHERE title IS NOT NULL OR text <> '')"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    raw = F.transform(
        lines,
        lambda line, k: F.struct(
            k.cast("int").alias("section_index"),
            F.when(k % 3 == 2, 1).otherwise(0).alias("depth"),
            F.when(k % 3 == 2, F.array(k - 1, k)).otherwise(F.array(k)).alias("chain"),
            F.get(F.array(*map(F.lit, _SECTION_TITLES)), k % 9).alias("title"),
            line.alias("text"),
        ),
    )
    return sections.assemble(load(spark, sf_dir, "documents").select("doc_id", raw.alias("raw_sections")))


@query(f"WITH {_SECTIONS_SQL} SELECT doc_id, CAST(k AS INTEGER) AS section_index, CAST(depth AS INTEGER) AS depth, title, bucket, replace(path_raw, '2. Methods', 'Methods') AS path_string FROM sections WHERE nth = 1")
def section_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section_index", "s.depth", "s.title", "s.bucket", "s.path_string")


@query(
    f"""WITH {_SECTIONS_SQL}, kept AS (SELECT * FROM sections WHERE nth = 1 AND trim(text) <> ''),
names AS (SELECT unnest([{", ".join(f"'{b}'" for b in T.BUCKETS)}]) AS bucket)
SELECT d.doc_id, n.bucket, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') AS indices, md5(trim(coalesce(string_agg(trim(s.text), chr(10) || chr(10) ORDER BY k), ''), ' ' || chr(10))) AS text_md5
FROM documents d CROSS JOIN names n LEFT JOIN kept s ON s.doc_id = d.doc_id AND s.bucket = n.bucket GROUP BY d.doc_id, n.bucket"""
)
def bucket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _assembled(spark, sf_dir)
    rows = papers.select("doc_id", sections.bucket_texts(F.col("buckets"), F.col("sections")).alias("texts"), F.explode("buckets").alias("bucket", "at"))
    return rows.select("doc_id", "bucket", F.array_join(F.transform("at", lambda k: k.cast("string")), ",").alias("indices"), F.md5(F.element_at("texts", F.col("bucket"))).alias("text_md5"))


@query(
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), f AS (SELECT doc_id, unnest(a) AS v, generate_subscripts(a, 1) AS k FROM w),
r AS (SELECT doc_id, k, v, row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY k) AS nth FROM f)
SELECT doc_id, string_agg(v, '|' ORDER BY k) AS keywords FROM r WHERE nth = 1 GROUP BY doc_id"""
)
def keyword_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a text, as if they were its keywords."""
    words = F.split("text", " ", -1)
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.distinct_ignoring_case(words), "|").alias("keywords"))


# DOIs of a document: a version, its number, and a name that is as long for some; every fifth has versions alone.
_DOI_COLUMNS = (
    "concat('10.1/', source, '.r00', doc_id % 7)", "CASE WHEN doc_id % 5 = 0 THEN concat('10.1/', source, '.r0', 100 + doc_id % 10) ELSE concat('10.1/', doc_id) END",
    "CASE WHEN doc_id % 5 = 0 THEN concat('10.1/', source, '.r0', 110 + doc_id % 3) ELSE concat('10.1/', 'x', doc_id % 1000) END",
)


@query(
    "WITH d AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {k} AS place, {c} AS doi FROM documents" for k, c in enumerate(_DOI_COLUMNS))
    + ") SELECT DISTINCT ON (doc_id) doc_id, doi FROM d ORDER BY doc_id, regexp_matches(doi, '\\.r\\d{3,}$'), length(doi), place"
)
def doi_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.best_doi(F.array(*map(F.expr, _DOI_COLUMNS))).alias("doi"))


@query(
    """WITH e AS (SELECT event_id, CAST(year(ts) AS VARCHAR) AS y, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN strftime(ts, '%b') ELSE CAST(month(ts) AS VARCHAR) END AS m,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(day(ts) AS VARCHAR) END AS d FROM events)
SELECT event_id, CASE WHEN m IS NULL THEN y WHEN d = '' THEN y || '-' || CASE WHEN length(m) < 2 THEN '0' || m ELSE m END
  ELSE y || '-' || CASE WHEN length(m) < 2 THEN '0' || m ELSE m END || '-' || CASE WHEN length(d) < 2 THEN '0' || d ELSE d END END AS date, CAST(y AS INTEGER) AS year FROM e"""
)
def pubdate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    year, n = F.year("ts").cast("string"), F.col("event_id")
    month = F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.date_format("ts", "MMM")).otherwise(F.month("ts").cast("string"))
    day = F.when(n % 3 == 0, "").otherwise(F.dayofmonth("ts").cast("string"))
    return e.select("event_id", T.partial_date(year, month, day).alias("date"), T.year_number(year).alias("year"))


SAMPLE, SEED, ORACLE_SIZES = 25, 42, (200, 1_000, 10_000)  # numbers of documents that the oracle has positions for


@query(
    "WITH s AS (SELECT * FROM (VALUES "
    + ", ".join(f"({n}, {k}, {p})" for n in ORACLE_SIZES for k, p in enumerate(random.Random(SEED).sample(range(n), SAMPLE)))
    + ") AS t(size, sample_pos, position)), d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS size FROM documents)"
    " SELECT CAST(sample_pos AS BIGINT) AS sample_pos, doc_id, source FROM d JOIN s USING (size, position)"
)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id")
    return sampling.seeded_sample(docs, SAMPLE, SEED).select("sample_pos", "doc_id", "source")


@query(f"SELECT page_id, md5({_normal_sql('html')}) AS text_md5, length({_normal_sql('html')}) AS n_chars FROM pages")
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalize_whitespace(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query("SELECT conv_id, turn, regexp_replace(text || '⟦S:' || turn || '⟧ and ⟦S' || conv_id || '⟧', '⟦S:?\\d+⟧', '', 'g') AS clean FROM conversations")
def citation_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.lit("⟦S:"), "turn", F.lit("⟧ and ⟦S"), "conv_id", F.lit("⟧"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_citations(marked).alias("clean"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS n_empty FROM documents GROUP BY source")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"))


@query(
    f"""WITH lines AS (SELECT doc_id, lang, string_split(text, chr(10)) AS a FROM documents),
good AS (SELECT *, list_filter(list_transform(a, lambda x: {_normal_sql("x")}), lambda x: x <> '') AS b FROM lines WHERE doc_id % 10 <> 3)
SELECT 'PMC' || doc_id AS paper_id, {_normal_sql("a[1]")} AS title, lang AS journal, CAST(1990 + doc_id % 30 AS INTEGER) AS year,
  (1990 + doc_id % 30) || '-0' || (1 + doc_id % 9) AS date, CAST(len(b) AS INTEGER) AS n_paragraphs, md5(array_to_string(b, chr(10) || chr(10))) AS text_md5, 'Results' AS section_title FROM good"""
)
def jats_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles made of documents, each tenth without front matter, through the parser."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(escape(F.col("text")), "\n", -1)
    n = F.col("doc_id")
    front = F.concat(
        F.lit("<front><journal-meta><journal-title>"), "lang", F.lit("</journal-title></journal-meta><article-meta><article-id pub-id-type='pmc'>"), n,
        F.lit("</article-id><title-group><article-title>"), F.get(lines, F.lit(0)), F.lit("</article-title></title-group><pub-date pub-type='epub'><month>"), 1 + n % 9,
        F.lit("</month><year>"), 1990 + n % 30, F.lit("</year></pub-date></article-meta></front>"),
    )
    body = F.concat(F.lit("<body><sec><title>Results</title><p>"), F.array_join(lines, "</p><p>"), F.lit("</p></sec></body>"))
    xml = F.concat(F.lit("<article>"), F.when(n % 10 == 3, "").otherwise(front), body, F.lit("</article>"))
    files = load(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), n, F.lit(".xml")).alias("path"), xml.cast("binary").alias("content"))
    good, _ = jats.papers(files)
    text = F.get("sections", F.lit(0))["text"]
    return good.select(
        "paper_id", "title", F.col("journal.name").alias("journal"), "published.year", "published.date",
        F.size(F.filter(F.split(text, "\n\n"), lambda p: p != "")).alias("n_paragraphs"), F.md5(text).alias("text_md5"), F.get("sections", F.lit(0))["title"].alias("section_title"),
    )


_PAPER_ID = "CASE WHEN n % 4 = 0 THEN 'PMC' || n WHEN n % 5 <> 0 THEN doi ELSE CAST(n AS VARCHAR) END"


@query(
    f"""WITH d AS (SELECT doc_id AS n, lang, source FROM documents),
e AS (SELECT *, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 3 = 0 THEN '10.1/d' || n || '.r001' ELSE '10.1/d' || n END AS doi FROM d)
SELECT n AS doc_id, {_PAPER_ID} AS paper_id, CASE WHEN n % 4 = 0 THEN 'PMC' || n END AS pmcid, CAST(n AS VARCHAR) AS pmid, doi,
  CAST(CASE WHEN n % 2 = 0 THEN 1990 ELSE 2000 END + n % 20 AS INTEGER) AS year,
  CASE WHEN n % 2 = 0 THEN (1990 + n % 20) || '-12-0' || (1 + n % 9) ELSE (2000 + n % 20) || '-0' || (1 + n % 9) END AS date,
  'Cancer|Lung ' || lang AS keywords,
  'Ann B.' || CAST(n AS VARCHAR) || ' (Univ ' || source || '; Lab ' || (n % 7) || ');Bo C (-)' AS authors,
  CASE n % 3 WHEN 0 THEN 'Aim: x ' || n || ' y tail' WHEN 1 THEN 'bare ' || n ELSE '' END AS abstract FROM e"""
)
def jats_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, dates, keywords, authors with affiliations and abstracts of articles made of documents, through the parser."""
    n, s = F.col("doc_id"), F.col("source")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    one_id = lambda kind, *value: text(f"<article-id pub-id-type='{kind}'>", *value, "</article-id>")
    ids = F.concat(
        F.when(n % 4 == 0, one_id("pmc", n)).otherwise(""), one_id("pmid", n),
        F.when(n % 5 == 0, "").otherwise(F.concat(one_id("doi", "10.1/d", n, ".r001"), F.when(n % 3 == 0, "").otherwise(one_id("doi", "10.1/d", n)))),
    )
    affiliation = text("<aff id='a1'>Univ ", s, "</aff><aff id='a2'><label>Lab</label>", n % 7, "</aff>")
    author = text(
        "<contrib-group><contrib contrib-type='author'><name><surname>B.", n, "</surname><given-names>Ann</given-names></name>",
        "<xref ref-type='aff' rid='a1'/><xref ref-type='aff' rid='a1'/><xref ref-type='aff' rid='a2'/><xref ref-type='fn' rid='a3'/></contrib>",
        "<contrib><name><surname>C</surname><given-names>Bo</given-names></name></contrib><contrib contrib-type='editor'><name><surname>E</surname></name></contrib>",
        "<contrib contrib-type='author'><collab>A group</collab></contrib></contrib-group>",
    )
    dates = F.concat(
        text("<pub-date pub-type='ppub'><month>", 1 + n % 9, "</month><year>", 2000 + n % 20, "</year></pub-date>"),
        F.when(n % 2 == 0, text("<pub-date pub-type='epub'><day>", 1 + n % 9, "</day><month>12</month><year>", 1990 + n % 20, "</year></pub-date>")).otherwise(""),
    )
    keywords = text("<kwd-group><kwd>Cancer</kwd><kwd>cancer</kwd><kwd/><kwd>Lung <i>", F.col("lang"), "</i></kwd></kwd-group>")
    abstract = (
        F.when(n % 3 == 0, text("<abstract><sec><title>Aim</title><p>x <b>", n, "</b></p><p>y</p></sec><p>tail</p></abstract>"))
        .when(n % 3 == 1, text("<abstract>bare ", n, "</abstract>")).otherwise("")
    )
    xml = F.concat(F.lit("<article><front><article-meta>"), ids, author, affiliation, dates, abstract, keywords, F.lit("</article-meta></front></article>"))
    good, _ = jats.papers(load(spark, sf_dir, "documents").select(text("/in/", n, ".xml").alias("path"), xml.cast("binary").alias("content")))
    person = lambda a: F.concat(a["first_name"], F.lit(" "), a["last_name"], F.lit(" ("), F.coalesce(a["affiliation"], F.lit("-")), F.lit(")"))
    return good.select(
        T.file_stem(F.col("file")).cast("long").alias("doc_id"), "paper_id", "ids.pmcid", "ids.pmid", "ids.doi", "published.year", "published.date",
        F.array_join("keywords", "|").alias("keywords"), F.array_join(F.transform("authors", person), ";").alias("authors"), "abstract",
    )


@query(
    f"""WITH w AS (SELECT doc_id, source, list_filter(string_split({_normal_sql("text")}, ' '), lambda x: x <> '') AS words FROM documents),
k AS (SELECT *, unnest(CASE WHEN len(words) = 0 THEN [] ELSE generate_series(0, CAST(ceil(greatest(len(words) - 345, 0) / 275.0) AS BIGINT)) END) AS k FROM w)
SELECT 'P' || doc_id AS paper_id, 'abstract' AS bucket, CAST(-1 AS INTEGER) AS section_index, CAST(k AS INTEGER) AS chunk_index, '' AS path_string,
  md5('Doc ' || doc_id || ' ' || source || chr(10) || chr(10) || array_to_string(list_slice(words, k * 275 + 1, k * 275 + 345), ' ')) AS text_md5 FROM k"""
)
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the tokenizer's offsets, each below the paper's title, which takes three tokens of the window."""
    papers = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("P"), "doc_id").alias("paper_id"), F.concat(F.lit("Doc "), "doc_id", F.lit(" "), "source").alias("title"),
        T.normalize_whitespace(F.col("text")).alias("abstract"), F.array().cast(schemas.SECTIONS).alias("sections"),
    )
    found, _ = chunking.chunks(papers, chunking.offsets_udf(chunking.word_tokenizer))
    return found.select("paper_id", "bucket", "section_index", "chunk_index", "path_string", F.md5("chunk_text").alias("text_md5"))


def _shared_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


@query(
    """SELECT 'k/' || doc_id || '.xml' AS key, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'A, "' || doc_id || '"' END AS accession_id, lang AS license FROM documents WHERE doc_id % 7 <> 0"""
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list as CSV with a column too many, blank keys, quotes and empty values, written and read."""
    n, path = F.col("doc_id"), _shared_path(spark)
    key = F.when(n % 7 == 0, "  ").otherwise(F.concat(F.lit(" k/"), n, F.lit(".xml ")))
    accession = F.when(n % 4 != 0, F.concat(F.lit('A, "'), n, F.lit('"')))
    rows = load(spark, sf_dir, "documents").select(key.alias("Key"), n.alias("Extra"), accession.alias("AccessionID"), F.col("lang").alias("License"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return filelist.read_file_list(spark, path)


@query(
    """SELECT CAST(row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS BIGINT) AS position, path FROM (SELECT source || '/' || lang || '/' || doc_id || '.xml' AS path FROM documents)"""
)
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".xml"))).alias("path"))
    return sampling.with_position(corpus.by_path(paths, "path")).select("position", "path")


@query(
    """SELECT CASE WHEN doc_id % 10 = 3 THEN CAST(doc_id AS VARCHAR) ELSE 'PMC' || doc_id END AS paper_id, CASE WHEN doc_id % 10 <> 3 THEN 'T ' || lang END AS title,
  CASE WHEN doc_id % 10 = 3 THEN 'no front matter' END AS error FROM documents"""
)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and error records as JSON lines, written and read; every tenth article has no front matter."""
    n, path = F.col("doc_id"), _shared_path(spark)
    front = F.concat(F.lit("<front><article-meta><article-id pub-id-type='pmc'>"), n, F.lit("</article-id><title-group><article-title>T <i>"), "lang", F.lit("</i></article-title></title-group></article-meta></front>"))
    xml = F.concat(F.lit("<article>"), F.when(n % 10 == 3, "").otherwise(front), F.lit("<body/></article>"))
    files = load(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), n, F.lit(".xml")).alias("path"), xml.cast("binary").alias("content"))
    good, errors = jats.papers(files, once=True)
    corpus.write_jsonl(good, errors, path)
    papers, bad = corpus.read_jsonl(spark, path)
    return papers.select("paper_id", "title", F.lit(None).cast("string").alias("error")).unionByName(bad.select("paper_id", F.lit(None).cast("string").alias("title"), "error"))


@query(
    """WITH d AS (SELECT DISTINCT ON (source, doc_id) source, doc_id, lang, text FROM documents ORDER BY source, doc_id, lang, text),
n AS (SELECT source AS paper_id, CAST(doc_id AS INTEGER) AS section_index, unnest([0, 1]) AS chunk_index, lang FROM d)
SELECT paper_id, section_index, chunk_index, CASE WHEN section_index % 2 = 0 AND chunk_index = 0 THEN 'new' ELSE lang END AS bucket, 'T' || section_index AS chunk_text FROM n"""
)
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts into a store in the shared folder, the second repeated as a batch of a stream and as an upsert of its own; the read merges."""
    n = F.col("doc_id")
    docs = load(spark, sf_dir, "documents").groupBy("source", "doc_id").agg(F.min("lang").alias("lang"))
    base = [F.col("source").alias("paper_id"), n.cast("int").alias("section_index"), F.lit("").alias("path_string"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("T"), n).alias("chunk_text"), F.array(F.lit(0.5).cast("float")).alias("embedding"), n.alias("seq")]
    first = docs.select(*base, F.col("lang").alias("bucket"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    second = docs.where("doc_id % 2 = 0").select(*base, F.lit("new").alias("bucket"), F.lit(0).alias("chunk_index"))
    store = corpus.ChunkStore(spark, _shared_path(spark))
    for number, batch in enumerate((first, second, second)):
        store.upsert(batch, "documents", min(number, 1))  # the third is the second again, as after a crash
    store.upsert(second)
    store.vacuum(0)
    return store.read().select("paper_id", "section_index", "chunk_index", "bucket", "chunk_text")
