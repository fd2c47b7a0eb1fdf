"""Base spans against Python's patterns, ownership on planted values, the plan without Python workers."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lectern.llm import credentials, queries
from lectern.llm.arrow import sha

PATTERNS = (
    (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)
DDL = "doc_id long, text string, source string"


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m))
    return spans, sha(",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in spans))


def run(spark, tmp_path, rows, ddl=DDL):
    path = f"{tmp_path}/{random.random()}"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{path}/documents.parquet")
    return queries.op11_secrets(spark, path).collect()


def test_base_equals_python(spark, tmp_path):
    rng = random.Random(1)
    pieces = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc123", "AKIA", "ABCD1234EFGH5678", "deadbeef0123", "0f" * 12, "é", "𝕊", "ſecret", "toKen=", ".", "-", "\n", "x"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(30))), f"s{k % 5}") for k in range(1500)]
    rows += [(2000, None, "s1"), (2001, "", None), (None, 'token = "abcdef12"', "s1"), (2002, "a" * 300_000 + " secret: " + "0f" * 100_000, "s"), (2003, 'token=token="token: abcdefgh', "s")]
    rows += [(2004, "token " + " " * 200_000 + "token = abc", "s"), (2005, "password: hunter22 " * 3_000, "s")]
    out = run(spark, tmp_path, rows)
    assert len(out) == len(rows)
    texts = {k: t for k, t, _ in rows}
    for r in out:
        spans, digest = brute(texts[r.doc_id])
        assert r.base_sha256 == digest, texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert {f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in spans} <= set(filter(None, r.spans.split(",")))


def secret(rng, n=32):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n - 4)) + "9aQ7"


def test_ownership_separates_copied_from_own(spark, tmp_path):
    rng = random.Random(2)
    copied, own, bare, loose, two = (secret(rng) for _ in range(5))
    rows = [(k, f"use token = {copied} here", f"owner{k}") for k in range(5)]
    rows += [(10, f"token = {own}", "a"), (11, f"seen {own} in a log.", "a"), (12, f"only {bare}.", "b"), (13, f"once {loose}", "c"), (14, f"again {loose}", "d"), (15, f"thrice {loose}", "e")]
    rows += [(20, f"secret: {two}", "a"), (21, f"secret: {two}", "b"), (22, "token = your_token_here_123", "a"), (23, f"bare {copied}", "z"), (24, "a/long/path/Of/Files/With/123/Parts/xyz", "q")]
    out = {r.doc_id: r for r in run(spark, tmp_path, rows)}
    assert all((out[k].n_live, out[k].n_example) == (0, 1) for k in (*range(5), 22))
    assert (out[10].n_live, out[11].spans, out[12].spans) == (1, "token:5:37", "token:5:37")
    assert out[11].n_assign == 0 and out[11].base_sha256 == sha("")
    assert [out[k].spans for k in (13, 14, 15, 23, 24)] == [""] * 5
    assert (out[20].n_unclear, out[21].n_unclear) == (1, 1)
    spans = credentials.scan_spans(spark.createDataFrame(rows, DDL)).where("doc_id = 0").first()
    assert (spans.n_owners, spans.n_repositories, spans.verdict) == (6, 6, "example")


def test_edges(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    rows = [(1, "token = abcdefgh1", "a", 1, 2, "x")] * 3 + [(1, "another", "a", 1, 2, "x")]
    out = run(spark, tmp_path, rows, DDL + ", kind int, row int, digest string")
    assert sorted(r.spans for r in out) == ["", *["assign:0:17"] * 3]
    null = run(spark, tmp_path, [(1, None, None), (None, "token = abcdefgh1", None), (None, None, "b")])
    assert sorted(r.spans for r in null) == ["", "", "assign:0:17"]


def test_hot_value(spark, tmp_path):
    rows = [(k, f"token = {'q1w2e3r4t5y6u7i8o9'} {k}", f"s{k % 2}") for k in range(6000)]
    out = run(spark, tmp_path, rows)
    assert len(out) == 6000 and {r.n_unclear for r in out} == {1}


def test_plan_is_native(spark):
    plan = queries.op11_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("value", ["aaaa", "ab12", "Aa1/+=x9Q", "deadbeef"])
def test_entropy(spark, value):
    from math import log2

    want = -sum(p * log2(p) for p in (value.count(c) / len(value) for c in set(value)))
    assert abs(spark.range(1).select(credentials.entropy(F.lit(value))).first()[0] - want) < 1e-9
