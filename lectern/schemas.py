"""Schemas of the records that the engine reads, makes and keeps."""

from __future__ import annotations

SECTION = "section_index int, depth int, path array<string>, path_string string, title string, bucket string, text string"

SECTIONS = "array<struct<" + ", ".join(": ".join(f.split(" ")) for f in SECTION.split(", ")) + ">>"

#: A parsed paper. published.date is partial text (YYYY[-MM[-DD]]), not a date.
PAPER = (
    "paper_id string, ids struct<pmcid: string, pmid: string, doi: string>, title string, journal struct<name: string>, "
    "published struct<year: int, date: string>, authors array<struct<first_name: string, last_name: string, affiliation: string>>, "
    "keywords array<string>, abstract string, buckets map<string, array<int>>, "
    "sections " + SECTIONS
)

#: A file that could not be parsed.
ERROR = "paper_id string, error string, file string"

CHUNK_COLUMNS = ("id", "paper_id", "bucket", "section_index", "chunk_index", "path_string", "title", "chunk_text", "embedding")
CHUNK_KEY = ("paper_id", "section_index", "chunk_index")
CHUNK = (
    "id bigint, paper_id string, bucket string, section_index int, chunk_index int, path_string string, "
    "title string, chunk_text string, embedding array<float>"
)
CHUNK_NOT_NULL = ("paper_id", "bucket", "section_index", "chunk_index", "chunk_text", "embedding")

FILE_LIST_COLUMNS = ("Key", "AccessionID", "License")
