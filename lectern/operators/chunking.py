"""Overlapping token windows over the parts of a paper."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.runtime import bound_batches, ship

WINDOW, OVERLAP = 348, 70
#: Characters of texts that a task cuts into tokens at once.
PIECE = 1 << 18


def window_starts(n: Column, header: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """First tokens of the windows over n tokens, when the header takes some of each window.

    Windows advance by the room less the overlap, at least 1, until one reaches the end;
    no tokens make no window. Null where the header leaves no room at all.
    """
    room = F.lit(window) - header
    step = F.greatest(F.lit(1), room - overlap)
    last = F.ceil(F.greatest(n - room, F.lit(0)) / step).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    return F.when(room > 0, starts)


def word_windows(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of white-space words, joined by single spaces: native, for corpora without a tokenizer."""
    words = F.filter(F.split(T.normalize_whitespace(text), " "), lambda w: w != "")
    return F.transform(window_starts(F.size(words), F.lit(0), window, overlap), lambda k: F.array_join(F.slice(words, k + 1, F.lit(window)), " "))


def edges(at: np.ndarray, header: int, window: int, overlap: int) -> np.ndarray:
    """Begins and ends, in the text, of the windows of window_starts() over tokens with these offsets."""
    n, room = len(at), window - header
    if not n or room <= 0:
        return np.zeros((0, 2), np.int32)
    step = max(1, room - overlap)
    first = np.arange(-(-max(n - room, 0) // step) + 1) * step
    return np.stack([at[first, 0], at[np.minimum(first + room, n) - 1, 1]], 1)


def offsets_udf(load: Callable[[], Callable[[list[str]], Iterable]]):
    """Function of (text, header, window, overlap), columns and numbers, that gives the number of the header's tokens and the edges of the text's windows.

    ``load`` runs once in each task and makes a function from texts to the (start, end) of
    their tokens. Tokens stay in the task as numbers, of PIECE characters of texts, or one
    text, at a time; only edges go back.
    """

    def windows(text: Column, header: Column, window: int, overlap: int) -> Column:
        @F.arrow_udf("struct<header_tokens: int, windows: array<struct<begin: int, end: int>>>")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            tokens = load()
            for texts, headers in batches:
                sizes, found = [], [np.zeros((0, 2), np.int32)]
                for own, above in _pieces(texts, headers):
                    for at, head in zip(tokens(own), tokens(above)):
                        sizes.append(len(head))
                        found.append(edges(np.asarray(at, np.int32).reshape(-1, 2), len(head), window, overlap))
                cut = pa.array(np.cumsum([len(x) for x in found]), pa.int32())
                flat = np.concatenate(found).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["begin", "end"])
                yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(cut, spans)], ["header_tokens", "windows"])

        return run(text, header)

    return windows


def _pieces(texts: pa.Array, headers: pa.Array) -> Iterator[tuple[list[str], list[str]]]:
    """Texts and headers, null as empty, in lists of about PIECE characters."""
    own, above, size = [], [], 0
    for text, header in zip(texts, headers):
        own.append(text.as_py() or "")
        above.append(header.as_py() or "")
        size += len(own[-1]) + len(above[-1])
        if size >= PIECE:
            yield own, above
            own, above, size = [], [], 0
    if own:
        yield own, above


def word_tokenizer():
    """Loader for offsets_udf of words between white space."""
    return lambda texts: (np.fromiter((x for m in re.finditer(r"\S+", t) for x in m.span()), np.int32).reshape(-1, 2) for t in texts)


def library_tokenizer(data: str):
    """Loader for offsets_udf of a tokenizers JSON text."""

    def load():
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data)
        return lambda texts: [e.offsets for e in t.encode_batch(texts, add_special_tokens=False)]

    return load


def parts(papers: DataFrame) -> DataFrame:
    """(paper_id, bucket, section_index, path_string, title, header, text): the abstract, then the sections.

    The abstract's header is the paper's title, a section's its path.
    """
    abstract = F.struct(F.lit("abstract").alias("bucket"), F.lit(-1).alias("section_index"), F.lit("").alias("path_string"), F.col("title").alias("header"), F.col("abstract").alias("text"))
    section = F.transform("sections", lambda s: F.struct(s["bucket"].alias("bucket"), s["section_index"].alias("section_index"), s["path_string"].alias("path_string"), s["path_string"].alias("header"), s["text"].alias("text")))
    rows = papers.select("paper_id", "title", *_order(papers), F.explode(F.concat(F.array(abstract), section)).alias("p"))
    return rows.select("paper_id", "p.bucket", "p.section_index", "p.path_string", "title", "p.header", "p.text", *_order(papers))


def _order(papers: DataFrame) -> list[str]:
    """The column that orders papers, if there is one: the later of two with one id wins an upsert."""
    return [c for c in ("seq",) if c in papers.columns]


def chunks(papers: DataFrame, offsets, window: int = WINDOW, overlap: int = OVERLAP, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, quarantine): chunks have chunk_index and chunk_text; parts whose header fills the window go to quarantine.

    ``seen`` has the number of parts in quarantine as bad, once an action has read all chunks.
    """
    ship(papers.sparkSession)
    bound_batches(papers.sparkSession)
    found = offsets(F.col("text"), F.col("header"), window, overlap)
    rows = parts(papers).withColumn("found", found).withColumn("header_tokens", F.col("found.header_tokens"))
    too_long = F.col("header_tokens") >= window
    if seen is not None:
        rows = rows.observe(seen, F.count_if(too_long).alias("bad"))
    bad = rows.where(too_long).select("paper_id", "section_index", F.concat(F.lit("header of "), "header_tokens", F.lit(" tokens leaves no room")).alias("error"))
    cut = rows.where(~too_long).select("*", F.posexplode("found.windows").alias("chunk_index", "at"))
    begin, end = F.col("at.begin"), F.col("at.end")
    body = T.strip(F.substring(F.col("text"), begin + 1, end - begin))
    return cut.select("paper_id", "bucket", "section_index", "chunk_index", "path_string", "title", T.with_header(F.col("header"), body).alias("chunk_text"), *_order(papers)), bad
