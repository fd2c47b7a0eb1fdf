"""Question to answer: both retrievals over the chunk table, then the generator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import bm25, embedding, lexical, rag, vector_search


@dataclass
class Asker:
    """Answers questions over a chunk table; the lexical index is made once."""

    chunks: DataFrame
    provider: embedding.Provider
    generate: rag.Generator | None = None
    top_chunks: int = vector_search.TOP_CHUNKS
    top_papers: int = vector_search.TOP_PAPERS
    evidence: int = vector_search.EVIDENCE
    candidates: int | None = None
    #: Where the lexical index is, one that follows upserts or one that bm25.write_index left; without it one is made and kept in memory.
    index_path: str | None = None
    _index: bm25.Index | None = field(default=None, repr=False)

    def sources(self, question: str) -> DataFrame:
        dense = vector_search.retrieve(self.chunks, embedding.embed_query(question, self.provider), self.candidates or self.top_chunks, self.top_papers, self.evidence)
        rows = self.chunks.withColumnRenamed("id", "chunk_id")
        if self._index is None and self.index_path:
            following = lexical.LexicalIndex(self.chunks.sparkSession, self.index_path)
            self._index = following.open() if following._current()["version"] else bm25.open_index(self.chunks.sparkSession, self.index_path)
        elif self._index is None:
            made = bm25.index(rows)
            self._index = bm25.Index(made.postings.persist(), made.terms.persist(), made.size.persist())
        found = bm25.top_papers(rows, bm25.scores(self._index, question), self.top_papers, self.top_chunks)
        return rag.dense_sources(dense).unionByName(rag.lexical_sources(found, rows.select("chunk_id", F.col("path_string"))))

    def ask(self, question: str) -> str:
        return rag.answer(question, self.sources(question), self.generate)

    def ask_many(self, questions: list[str]) -> list[str]:
        """Answers in the order of the questions; the index is made, or read, once."""
        return [self.ask(q) for q in questions]

    def close(self) -> None:
        """Frees what the lexical index holds in memory; the next question makes it anew."""
        if self._index is not None and self.index_path is None:
            for table in (self._index.postings, self._index.terms, self._index.size):
                table.unpersist()
        self._index = None
