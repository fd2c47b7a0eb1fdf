import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sections as S

TITLES = {
    # title: (normalized, strong, weak)
    "Results and Discussion": ("results and discussion", "results", None),
    "Discussion and Conclusions": ("discussion and conclusions", "discussion", None),
    "Methods and Results": ("methods and results", "methods", None),
    "Methods, Results and Discussion": ("methods results and discussion", "results", None),
    "Result": ("result", "results", None),
    "Statistical analysis": ("statistical analysis", None, "methods"),
    "Ethics approval": ("ethics approval", None, None),
    "1. Introduction": ("introduction", "introduction", None),
    "I) Methods": ("methods", "methods", None),
    "Section 2: Results": ("results", "results", None),
    "T-cell assays": ("cell assays", None, None),
    "Cohort": ("cohort", None, None),
    "": ("", None, None),
    None: ("", None, None),
    " 2.1 Étude ": ("1 tude", None, None),
    "Materials and  Methods": ("materials and methods", "methods", None),
    "Summary of findings": ("summary of findings", "results", None),
}


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "title string")
    n = T.normalize_title(F.col("title"))
    got = {r.title: (r.n, r.strong, r.weak) for r in df.select("title", n.alias("n"), T.strong_bucket(n).alias("strong"), T.weak_bucket(n).alias("weak")).collect()}
    assert got == TITLES


def walk(tree, inherit):
    """Buckets of a tree of (title, children), step by step."""
    out, last = [], {}

    def go(node, parent, depth):
        title, children = node
        _, strong, weak = TITLES[title]
        found = strong or (weak if parent is None else None) or parent
        admin = title == "Ethics approval"
        if inherit and found is None and not admin:
            found = last.get(depth)
        found = found or (title or "").strip() or "untitled"
        out.append(found)
        if strong:
            last[depth] = strong
        for c in children:
            go(c, found, depth + 1)

    for node in tree:
        go(node, None, 0)
    return out


def flatten(tree):
    rows = []

    def go(node, chain):
        me = [*chain, len(rows)]
        rows.append({"section_index": me[-1], "depth": len(chain), "chain": me, "title": node[0] or None, "text": "x"})
        for c in node[1]:
            go(c, me)

    for node in tree:
        go(node, [])
    return rows


@pytest.mark.parametrize("inherit", [True, False])
def test_closed_form_equals_walk(spark, inherit):
    rng = random.Random(7)
    titles = [t for t in TITLES if t != " 2.1 Étude "]

    def tree(depth):
        return [(rng.choice(titles), tree(depth + 1) if depth < 3 else []) for _ in range(rng.randrange(4 - depth))]

    trees = [tree(0) for _ in range(150)]
    df = spark.createDataFrame([(k, flatten(t)) for k, t in enumerate(trees)], f"k int, raw array<struct<{S._typed(S.RAW)}>>")
    got = df.select("k", F.transform(S.with_buckets(F.col("raw"), inherit), lambda s: s["bucket"]).alias("b")).collect()
    for r in got:
        assert r.b == walk(trees[r.k], inherit)


def test_index_text_and_duplicates(spark):
    rows = [
        {"section_index": 0, "depth": 0, "chain": [0], "title": "Methods", "text": ""},
        {"section_index": 1, "depth": 1, "chain": [0, 1], "title": "A. Mice", "text": "m"},
        {"section_index": 2, "depth": 1, "chain": [0, 2], "title": "A. Mice", "text": "m"},
        {"section_index": 3, "depth": 1, "chain": [0, 3], "title": None, "text": ""},
        {"section_index": 4, "depth": 1, "chain": [0, 4], "title": "B.", "text": " n "},
        {"section_index": 5, "depth": 0, "chain": [5], "title": "Results", "text": "r"},
    ]
    df = spark.createDataFrame([("p", rows), ("q", None)], f"paper_id string, raw_sections array<struct<{S._typed(S.RAW)}>>")
    out = {r.paper_id: r for r in S.assemble(df).withColumn("t", S.bucket_text(F.col("buckets"), F.col("sections"), "methods")).withColumn("none", S.bucket_text(F.col("buckets"), F.col("sections"), "abstract")).collect()}
    p = out["p"]
    assert [s.section_index for s in p.sections] == [0, 1, 4, 5]
    assert [s.path_string for s in p.sections] == ["Methods", "Methods > Mice", "Methods > ", "Results"]
    assert p.buckets == {"introduction": [], "methods": [1, 4], "results": [5], "discussion": [], "conclusion": []}
    assert p.t == "m\n\nn" and p.none == "" and out["q"].sections == []


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda s: F.lit(s).cast("string")
    assert one(T.normalize_whitespace(F.lit(" a  \x1c b\n"))) == "a b" and one(T.normalize_whitespace(lit(None))) == ""
    assert one(T.partial_date(lit("2019"), lit("12"), lit("3"))) == "2019-12-03"
    assert one(T.partial_date(lit("2020"), lit("Jan"), lit(None))) == "2020-Jan"
    assert one(T.partial_date(lit("2020"), lit(None), lit("5"))) == "2020" and one(T.partial_date(lit(""), lit("1"), lit("2"))) is None
    assert one(T.year_number(lit("2020"))) == 2020 and one(T.year_number(lit("c2020"))) is None and one(T.year_number(lit("99999999999"))) is None
    assert one(T.best_doi(F.array(F.lit("10.1/x.r001"), F.lit("10.1/abcdef"), F.lit("10.1/abcdeg")))) == "10.1/abcdef"
    assert one(T.best_doi(F.array().cast("array<string>"))) is None
    assert one(T.distinct_ignoring_case(F.array(F.lit("Cancer"), F.lit("cancer"), F.lit("Lung")))) == ["Cancer", "Lung"]
    assert one(T.joined_distinct(F.array(F.lit("a"), F.lit("a"), F.lit("b")))) == "a; b" and one(T.joined_distinct(F.array().cast("array<string>"))) is None
    assert one(T.prefixed_pmcid(F.lit("12"))) == "PMC12" and one(T.prefixed_pmcid(F.lit("PMC12"))) == "PMC12"
    assert one(T.file_stem(F.lit("file:/a/b.c.xml"))) == "b.c" and one(T.file_stem(F.lit("/a/.xml"))) == ".xml"
    assert one(T.without_citations(F.lit("a⟦S:1⟧ b⟦S2⟧"))) == "a b"
    assert one(T.first_filled(lit(""), lit(None), lit("x"))) == "x"
    assert one(T.tokens(F.lit("The T-cell, don't (stop)! p53 covid-19 tumour's end."))) == ["stop", "tumour", "end"]
    assert one(T.with_header(F.lit(" h "), F.lit("b"))) == "h\n\nb" and one(T.with_header(lit(""), F.lit("b"))) == "b"


def test_many_sections_of_one_paper_are_linear(spark):
    """Against a plain walk, over thousands of sections."""
    n = 5000
    titles = ["Methods", "Cohort", None, "Funding", "Results", "Details"]
    raw = [(k, 0 if k % 3 else 1, [k] if k % 3 else ([k - 1, k] if k else [k]), titles[k % 6] if k % 5 else f"T{k % 40}", f"x{k % 900}") for k in range(n)]
    df = spark.createDataFrame([(1, raw)], f"id int, raw_sections array<struct<section_index: int, depth: int, chain: array<int>, title: string, text: string>>")
    row = S.assemble(df).first()
    seen, kept = set(), []
    for s in row.sections:
        assert (s.path_string, s.text) not in seen
        seen.add((s.path_string, s.text))
        kept.append(s.section_index)
    assert kept == sorted(kept) and len(kept) > 900
    strong = {"Methods": "methods", "Results": "results"}
    at = {s.section_index: s.bucket for s in row.sections}
    carry = None
    for k, depth, _, title, _ in raw:
        if depth == 0 and k in at:
            want = strong.get(title) or (carry if title != "Funding" else None) or title or "untitled"
            assert at[k] == want, (k, title)
        if depth == 0:
            carry = strong.get(title) or carry
    text = spark.createDataFrame([row]).select(S.bucket_text(F.col("buckets"), F.col("sections"), "methods")).first()[0]
    texts = {s.section_index: s.text for s in row.sections}
    assert text == "\n\n".join(texts[k] for k in row.buckets["methods"])


def test_texts_of_all_buckets_equal_each(spark):
    blank = [" ", "\x1c x \n", " a", "b ", "", "c d", "\n\n", "e\n"]
    rows = [(k, [(j, 0, [j], ["Methods", "Results", "Funding", None][(j + k) % 4], blank[(j * 3 + k) % 8]) for j in range(k)]) for k in range(0, 25, 3)]
    df = spark.createDataFrame(rows, f"id int, raw_sections array<struct<{S._typed(S.RAW)}>>")
    each = F.create_map(*[x for b in T.BUCKETS for x in (F.lit(b), S.bucket_text(F.col("buckets"), F.col("sections"), b))])
    out = S.assemble(df).select("sections", "buckets", S.bucket_texts(F.col("buckets"), F.col("sections")).alias("all"), each.alias("each")).collect()
    for r in out:
        texts = {s.section_index: s.text for s in r.sections}
        assert all((texts[k] or "").strip() for at in r.buckets.values() for k in at)
        assert r.all == r.each == {b: "\n\n".join(texts[k].strip() for k in at) for b, at in r.buckets.items()}


def test_marks_of_a_title_equal_its_tests(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "title string")
    for r in df.select("title", T.title_marks(F.col("title")).alias("m"), T.is_admin(T.normalize_title(F.col("title"))).alias("admin")).collect():
        assert (r.m.strong, r.m.weak, r.m.admin) == (*TITLES[r.title][1:], r.admin)
