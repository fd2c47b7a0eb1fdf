import json

import pytest

from lectern.operators import chunking, embedding
from lectern.plans.ask import Asker
from lectern.sources import corpus, jats, objects
from lectern.streaming import ingest

ARTICLE = """<!DOCTYPE article PUBLIC "-//X//DTD" "x.dtd">
<article xmlns:x="u"><front><journal-meta><journal-title>The <i>Journal</i></journal-title></journal-meta>
<article-meta>
<article-id pub-id-type="pmc">77</article-id><article-id pub-id-type="pmid"> 5 </article-id><article-id pub-id-type="pmid">6</article-id>
<article-id pub-id-type="doi">10.1/x.r001</article-id><article-id pub-id-type="DOI">10.1/abcdef</article-id>
<title-group><article-title>H<sub>2</sub>O in rats</article-title></title-group>
<contrib-group>
<contrib contrib-type="author"><name><surname>Lee</surname><given-names>A</given-names></name><xref ref-type="aff" rid="a1"/><xref ref-type="aff" rid="a1"/><xref ref-type="aff" rid="no"/></contrib>
<contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib>
<contrib><collab>Group</collab></contrib>
<contrib><name><surname>Noaff</surname></name></contrib>
</contrib-group>
<aff id="a1">old</aff><aff id="a1"><label>1</label>Uni</aff><aff>no id</aff>
<pub-date pub-type="ppub"><year>2020</year><month>01</month></pub-date><pub-date pub-type="epub"><day>3</day><month>12</month><year>2019</year></pub-date>
<abstract><title>Abstract</title><sec><title>Aim</title><p>To see.</p></sec><p>End.</p></abstract>
<kwd-group><kwd>Cancer</kwd><kwd>cancer</kwd><kwd>Lung</kwd></kwd-group>
</article-meta></front>
<body><p>lost</p>
<sec><title>1. Methods</title><p>We did <fig><caption><p>figure</p></caption></fig> it.</p>
  <list><list-item><p>one</p><list><list-item><p>two</p></list-item></list></list-item><list-item>bare</list-item></list>
  <sec><title>Statistical analysis</title><p>t test</p></sec></sec>
<sec><title>Cohort</title><table-wrap><p>skip</p></table-wrap><p>rats</p></sec>
<sec><title>Ethics approval</title><p>yes</p></sec>
<sec><p>a&#160;b</p></sec>
</body></article>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("xml")
    (path / "sub").mkdir()
    (path / "sub" / "one.xml").write_text(ARTICLE)
    (path / "bare.xml").write_text("<article><front><article-meta/></front></article>")
    (path / "note.xml").write_text("<note/>")
    (path / "nofront.xml").write_text("<article/>")
    (path / "nometa.xml").write_text("<article><front/></article>")
    (path / "broken.xml").write_text("<article>&nope;</article>")
    (path / "other.txt").write_text("x")
    return path


def test_record(spark, folder):
    good, errors = jats.papers(objects.xml_files(spark, str(folder)))
    by = {r.paper_id: r for r in good.collect()}
    assert set(by) == {"PMC77", "bare"} and {r.paper_id for r in errors.collect()} == {"note", "nofront", "nometa", "broken"}
    p = by["PMC77"]
    assert p.ids.asDict() == {"pmcid": "PMC77", "pmid": "6", "doi": "10.1/abcdef"}
    assert p.title == "H 2 O in rats" and p.journal.name == "The Journal"
    assert (p.published.year, p.published.date) == (2019, "2019-12-03")
    assert [(a.first_name, a.last_name, a.affiliation) for a in p.authors] == [("A", "Lee", "1 Uni"), (None, "Noaff", None)]
    assert p.keywords == ["Cancer", "Lung"] and p.abstract == "Aim: To see. End."
    assert [(s.section_index, s.depth, s.title, s.bucket) for s in p.sections] == [
        (0, 0, "1. Methods", "methods"), (1, 1, "Statistical analysis", "methods"), (2, 0, "Cohort", "methods"), (3, 0, "Ethics approval", "Ethics approval"), (4, 0, None, "methods"),
    ]
    assert p.sections[0].text == "We did figure it.\n\n- one\n- two\n- two\n- bare" and p.sections[1].path_string == "Methods > Statistical analysis"
    assert p.sections[2].text == "rats" and p.sections[4].text == "a b"
    assert p.buckets["methods"] == [0, 1, 2, 4] and p.buckets["results"] == []
    b = by["bare"]
    assert (b.title, b.abstract, b.sections, b.authors, b.keywords, b.published.date) == (None, "", [], [], [], None)
    alone = {r.paper_id: r for r in jats.papers(objects.xml_files(spark, str(folder)), inherit=False)[0].collect()}["PMC77"]
    assert [s.bucket for s in alone.sections] == ["methods", "methods", "Cohort", "Ethics approval", "untitled"]


def test_files(spark, folder):
    assert objects.count_xml_files(spark, str(folder)) == 6
    assert objects.xml_files(spark, str(folder / "other.txt")).count() == 1


def loops(text, header, window, overlap):
    """Window by window, as one would by hand."""
    import re

    spans = [m.span() for m in re.finditer(r"\S+", text or "")]
    room = window - len((header or "").split())
    out, at = [], 0
    while at < len(spans):
        end = min(at + room, len(spans))
        body = text[spans[at][0] : spans[end - 1][1]].strip()
        out.append(f"{header.strip()}\n\n{body}" if header else body)
        if end == len(spans):
            break
        at += max(1, room - overlap)
    return out


def test_chunks_equal_loop(spark):
    import random

    rng = random.Random(0)
    rows = []
    for k in range(80):
        words = " ".join(rng.choice(["a", "bb", "c\n", "é\U0001f642"]) for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 30])))
        sections = [{"bucket": "b", "section_index": 5, "path_string": " ".join(["h"] * rng.randrange(9)), "text": words}]
        rows.append((f"p{k}", rng.choice([None, "", "a title"]), words, sections))
    papers = spark.createDataFrame(rows, "paper_id string, title string, abstract string, sections array<struct<bucket: string, section_index: int, path_string: string, text: string>>")
    offsets = chunking.offsets_udf(chunking.word_tokenizer)
    found, bad = chunking.chunks(papers, offsets, 8, 3)
    got = {}
    for r in found.collect():
        got.setdefault((r.paper_id, r.section_index), {})[r.chunk_index] = r.chunk_text
    too_long = {(r.paper_id, r.section_index) for r in bad.collect()}
    for p, title, text, sections in rows:
        for index, header in ((-1, title), (5, sections[0]["path_string"])):
            if len((header or "").split()) >= 8:
                assert (p, index) in too_long
            else:
                want = loops(text, header, 8, 3)
                assert [x for _, x in sorted(got.get((p, index), {}).items())] == want


@pytest.mark.parametrize("n,header,count", [(0, 0, 0), (1, 0, 1), (348, 0, 1), (349, 0, 2), (626, 0, 2), (627, 0, 3), (5, 348, None)])
def test_window_counts(spark, n, header, count):
    from pyspark.sql import functions as F

    out = spark.range(1).select(chunking.window_starts(F.lit(n), F.lit(header)).alias("s")).first().s
    assert (out if out is None else len(out)) == count


def test_jsonl_store_stream_and_answer(spark, folder, tmp_path):
    good, errors = jats.papers(objects.xml_files(spark, str(folder)))
    corpus.write_jsonl(good, errors, str(tmp_path / "corpus"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "corpus")).collect()]
    assert len(lines) == 6 and any("title" in x and x["title"] is None for x in lines)
    papers, bad = corpus.read_jsonl(spark, str(tmp_path / "corpus"))
    assert papers.count() == 2 and bad.count() == 4
    assert {r.paper_id: r.sections for r in papers.collect()} == {r.paper_id: r.sections for r in good.collect()}
    with pytest.raises(ValueError):
        corpus.write_single_json(good, str(tmp_path / "x"))
    corpus.write_single_json(good.where("paper_id = 'bare'"), str(tmp_path / "single"))
    assert json.loads(spark.read.text(str(tmp_path / "single")).first().value)["title"] is None

    store = corpus.ChunkStore(spark, str(tmp_path / "store"))
    offsets = chunking.offsets_udf(chunking.word_tokenizer)
    query = ingest.stream(spark, str(folder), store, offsets, embedding.hashing_provider(32), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    first = store.read().collect()
    assert len(first) == 6 and len({r.id for r in first}) == 6
    ingest.ingest(objects.xml_files(spark, str(folder)), store, offsets, embedding.hashing_provider(32))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, first))
    store.vacuum(0)
    chunks = store.read()
    asker = Asker(chunks, embedding.hashing_provider(32), top_papers=2, evidence=2)
    prompt = asker.ask("rats t test")
    assert "[S:1] Paper: PMC77 - H 2 O in rats - " in prompt and prompt.endswith("QUESTION:\nrats t test\n") and "[S:3]" in prompt
    assert Asker(chunks, embedding.hashing_provider(32), lambda p, r: "yes⟦S:1⟧").ask("rats") == "yes"
    with pytest.raises(ValueError):
        store.upsert(chunks.withColumn("chunk_text", chunks.title.cast("string")).limit(1).selectExpr("paper_id", "bucket", "99 as section_index", "chunk_index", "path_string", "title", "cast(null as string) as chunk_text", "embedding", "1L as seq"))
    assert store.read().count() == 6


def test_whatever_breaks_only_its_file(spark):
    good = b"<article><front><article-meta><article-id pub-id-type='pmid'>7</article-id></article-meta></front></article>"
    bad = [b"<?xml version='1.0' encoding='no-such-code'?><article/>", None, b"", b"\xff\xfe\x00", b"<article>"]
    files = spark.createDataFrame([(f"/x/{k}.xml", c) for k, c in enumerate([good, *bad])], "path string, content binary")
    papers, errors = jats.papers(files, once=True)
    assert [r.paper_id for r in papers.collect()] == ["7"] and errors.count() == len(bad)
    assert all(r.error for r in errors.collect())
