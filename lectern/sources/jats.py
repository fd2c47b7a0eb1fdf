"""JATS article XML into paper records.

A parser in Python emits only what the tree holds (texts in document order, attributes,
nesting); choosing, de-duplicating and classifying are Catalyst expressions over it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.functions import text as T
from lectern.operators import sections as S
from lectern.runtime import bound_batches, cut, ship

RAW_PAPER = (
    "file string, error string, article_ids array<struct<type: string, value: string>>, title string, journal string, "
    "pub_dates array<struct<type: string, year: string, month: string, day: string>>, keywords_raw array<string>, "
    "affiliations array<struct<id: string, text: string>>, "
    "authors_raw array<struct<first_name: string, last_name: string, rids array<string>>>, abstract string, "
    "raw_sections array<struct<section_index: int, depth: int, chain: array<int>, title: string, text: string>>"
).replace("rids array", "rids: array")

_SPACE = re.compile(r"\s+")
Element = ElementTree.Element


def _tidy(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def _name(element: Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _all(element: Element, name: str) -> Iterator[Element]:
    return (e for e in element.iter() if _name(e) == name)


def _children(element: Element, name: str) -> Iterator[Element]:
    return (e for e in element if _name(e) == name)


def _text(element: Element | None) -> str | None:
    """All text of an element, its pieces parted by spaces; null for no element."""
    return None if element is None else _tidy(" ".join(element.itertext()))


def _attribute(element: Element, name: str) -> str:
    return (element.get(name) or "").lower()


def _abstract(meta: Element) -> str:
    abstract = next(_all(meta, "abstract"), None)
    if abstract is None:
        return ""
    parts: list[str] = []
    for child in abstract:
        if _name(child) == "p":
            parts.append(_text(child))
        elif _name(child) == "sec":
            heading = _text(next(_children(child, "title"), None))
            parts.append(f"{heading}:" if heading else "")
            parts += map(_text, _all(child, "p"))
    return _tidy(" ".join(filter(None, parts)) or _text(abstract))


def _list_lines(element: Element) -> str:
    """One "- text" line for each paragraph of each item, or for an item without any; inner items come again after outer ones."""
    lines = (_text(leaf) for item in _all(element, "list-item") for leaf in (list(_all(item, "p")) or [item]))
    return "\n".join(f"- {x}" for x in lines if x)


def _own_text(section: Element) -> str:
    """Paragraphs and lists right below a section, with empty lines between."""
    reader = {"p": _text, "list": _list_lines}
    blocks = (reader[_name(c)](c) for c in section if _name(c) in reader)
    return "\n\n".join(b for b in blocks if b)


def _sections(body: Element) -> list[dict]:
    """Sections in document order, numbered, each with the numbers of its ancestors and itself."""
    out: list[dict] = []
    stack = [(s, []) for s in reversed(list(_children(body, "sec")))]
    while stack:
        section, above = stack.pop()
        chain = [*above, len(out)]
        title = _text(next(_children(section, "title"), None))
        out.append({"section_index": len(out), "depth": len(above), "chain": chain, "title": title or None, "text": _own_text(section)})
        stack += [(s, chain) for s in reversed(list(_children(section, "sec")))]
    return out


def _title(meta: Element) -> str | None:
    found = (t for group in _all(meta, "title-group") for t in _all(group, "article-title"))
    return _text(next(found, None))


def _author(contrib: Element) -> dict | None:
    name = next(_children(contrib, "name"), None)
    if name is None or _attribute(contrib, "contrib-type") not in ("author", ""):
        return None
    last = lambda tag: ([_text(e) for e in _children(name, tag)] or [None])[-1]
    rids = [x.get("rid") for x in _all(contrib, "xref") if _attribute(x, "ref-type") == "aff" and x.get("rid")]
    return {"first_name": last("given-names"), "last_name": last("surname"), "rids": rids}


def _date(element: Element) -> dict:
    last = {_name(c): _tidy(c.text) for c in element}
    return {"type": _attribute(element, "pub-type")} | {k: last.get(k) for k in ("year", "month", "day")}


def parse_article(content: bytes) -> dict:
    """The raw fields of one article; ValueError if it is none."""
    root = ElementTree.fromstring(content)
    if _name(root) != "article":
        raise ValueError("not an article")
    front = next(_all(root, "front"), None)
    if front is None:
        raise ValueError("no front matter")
    meta = next(_all(front, "article-meta"), None)
    if meta is None:
        raise ValueError("no article metadata")
    journal = next(_all(front, "journal-meta"), None)
    body = next(_all(root, "body"), None)
    affiliations = ((a.get("id"), _text(a)) for a in _all(front, "aff"))
    return {
        "article_ids": [{"type": _attribute(e, "pub-id-type"), "value": v} for e in _all(meta, "article-id") if (v := _tidy(e.text))],
        "title": _title(meta),
        "journal": None if journal is None else _text(next(_all(journal, "journal-title"), None)),
        "pub_dates": [_date(e) for e in _all(meta, "pub-date")],
        "keywords_raw": [k for k in map(_text, _all(front, "kwd")) if k],
        "affiliations": [{"id": i, "text": t} for i, t in affiliations if i and t],
        "authors_raw": [a for a in map(_author, _all(meta, "contrib")) if a],
        "abstract": _abstract(meta),
        "raw_sections": [] if body is None else _sections(body),
    }


#: Bytes of files, and files, whose records are made into one batch, about.
BATCH_BYTES, BATCH_FILES = 1 << 20, 256


def _record(path: str, content: bytes) -> dict:
    """The raw fields of a file, or only its error: whatever a file breaks, only that file goes to quarantine."""
    try:
        return parse_article(content) | {"file": path}
    except Exception as reason:
        return {"error": f"{reason}" or type(reason).__name__, "file": path}


def _batches(held: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records as one batch, or one by one if a value of some cannot be told in Arrow."""
    try:
        yield pa.RecordBatch.from_pylist(held, schema)
    except Exception as reason:
        if len(held) > 1:
            for row in held:
                yield from _batches([row], schema)
        else:
            yield pa.RecordBatch.from_pylist([{"error": f"{reason}" or type(reason).__name__, "file": held[0]["file"]}], schema)


def records(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of raw fields of batches of files (path, content); what is held is bounded in bytes and in files."""
    held, size = [], 0
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            data = content.as_py()
            held.append(_record(path.as_py(), data))
            size += len(data or b"")
            if size > BATCH_BYTES or len(held) >= BATCH_FILES:
                yield from _batches(held, schema)
                held, size = [], 0
    if held:
        yield from _batches(held, schema)


def raw_papers(files: DataFrame) -> DataFrame:
    """RAW_PAPER of binary files (path, content); a file that can't be parsed has only file and error."""
    ship(files.sparkSession)
    bound_batches(files.sparkSession)
    kind = _parse_datatype_string(RAW_PAPER)
    schema = to_arrow_schema(kind)

    return files.select("path", "content").mapInArrow(lambda batches: records(batches, schema), kind)


def _last_of(kind: str):
    of = F.filter("article_ids", lambda a: (a["type"] == kind) if kind != "pmc" else a["type"].isin("pmc", "pmcid"))
    return F.try_element_at(of, F.lit(-1))["value"]


def chosen_date(dates):
    """The first of the most preferred kind of publication date."""
    # Preference among kinds.
    order = F.array(*map(F.lit, ("epub", "ppub", "pub", "collection")))
    ranked = F.transform(dates, lambda d, k: F.struct(F.when(F.array_contains(order, d["type"]), F.array_position(order, d["type"])).otherwise(999).alias("rank"), k.alias("at"), d.alias("date")))
    return F.array_min(ranked)["date"]


def papers(files: DataFrame, inherit: bool = True, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers, errors) of binary files: records in the schema PAPER plus file, and quarantined files in the schema ERROR.

    once: parse at once and keep what was parsed in the shared folder, for callers that use both.
    """
    raw = cut(raw_papers(files)) if once else raw_papers(files)
    errors = raw.where("error is not null").select(T.file_stem(F.col("file")).alias("paper_id"), "error", "file")
    good = raw.where("error is null")
    pmc = _last_of("pmc")
    ids = F.struct(
        F.when(pmc.isNotNull(), T.prefixed_pmcid(pmc)).alias("pmcid"), _last_of("pmid").alias("pmid"),
        T.best_doi(F.transform(F.filter("article_ids", lambda a: a["type"] == "doi"), lambda a: a["value"])).alias("doi"),
    )
    names = lambda a: F.filter(F.transform(a["rids"], lambda r: F.try_element_at(F.filter("affiliations", lambda f: f["id"] == r), F.lit(-1))["text"]), lambda t: t.isNotNull())
    author = lambda a: F.struct(a["first_name"].alias("first_name"), a["last_name"].alias("last_name"), T.joined_distinct(names(a)).alias("affiliation"))
    date = F.col("date")
    out = good.withColumn("ids", ids).withColumn("date", chosen_date(F.col("pub_dates")))
    out = out.select(
        T.first_filled(F.col("ids.pmcid"), F.col("ids.doi"), F.col("ids.pmid"), T.file_stem(F.col("file"))).alias("paper_id"),
        "ids", "title", F.struct(F.col("journal").alias("name")).alias("journal"),
        F.struct(T.year_number(date["year"]).alias("year"), T.partial_date(date["year"], date["month"], date["day"]).alias("date")).alias("published"),
        F.transform("authors_raw", author).alias("authors"), T.distinct_ignoring_case(F.col("keywords_raw")).alias("keywords"),
        "abstract", "raw_sections", "file",
    )
    done = S.assemble(out, inherit=inherit)
    return done.select("paper_id", "ids", "title", "journal", "published", "authors", "keywords", "abstract", "buckets", "sections", "file"), errors
