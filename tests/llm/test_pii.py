import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PIECES = ["a.b", "@", "x@y.com", ".", "10.0.0.1", "256.1.1.1", "1.2.3", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "0", "-", " ", "é", "\n", "12", "(", "@@", "..", "+49"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_equals_patterns(pieces):
    text = "".join(pieces)
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0189.+- ()@a\n", max_size=60))
def test_base_equals_patterns_on_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_fast():
    for c in ("1", "a", "1.", "@", "+1", "1 "):
        text = c * 200_000
        pii.candidates(text, pii.base_spans(text))


def test_numbers_of_any_length():
    zeros = "0" * 5_000
    assert pii.base_spans(f"see 1.2.3.{zeros}1 end") == [(4, 1, 11 + len(zeros))]
    assert pii.base_spans(f"1.2.3.{zeros}256") == [] and pii.base_spans(f"{zeros}.0.0.0")[0][1] == 1
    assert pii.base_spans("9" * 10_000 + ".1.1.1") == []


def test_contexts_discover_identifiers(spark):
    good = [(k, f"hello there call me at +1 (555) 010-{1000 + k} today") for k in range(6)]
    noise = [(20 + k, f"it cost about 55{k}-123-99{k:02d} in all") for k in range(6)]
    new = [(50, "please call me at 555-867-5309 soon"), (51, None), (52, ""), (52, ""), (None, "mail a@b.co")]
    out = {}
    rows = pii.find(spark.createDataFrame(good + noise + new, "doc_id long, text string")).withColumn("spans", pii.spans_column()).collect()
    assert len(rows) == len(good) + len(noise) + len(new)
    for r in rows:
        out[r.doc_id] = r
    at = new[0][1].index("555")
    assert out[50].spans == f"phone:{at}:{at + 12}" and out[50].n_phone == 0
    assert out[20].spans == "" and out[51].spans == "" and out[51].base_sha256 == pii.sha("")
    assert out[None].spans == "email:5:11"
    assert out[0].base_sha256 == pii.sha(out[0].spans)


def brute_known(rows, support, trust):
    """Trusted (context, kind) and known (instance, kind) by plain loops over all mentions."""
    shapes, seeds, members = {}, {}, {}
    for text in rows:
        for m in pii.mentions_of(text, pii.base_spans(text)):
            for c in m["contexts"]:
                members.setdefault(c, set()).add(m["instance"])
                shapes.setdefault((c, m["instance"]), set()).update(m["shapes"])
                if m["seed"] >= 0:
                    seeds[c, m["instance"]] = m["seed"]
    known = {(i, k): 1.0 for (c, i), k in seeds.items() if len(members[c]) >= support}
    while True:
        trusted = {}
        for c, own in members.items():
            for kind in range(4):
                scores = [known[i, kind] for i in own if (i, kind) in known]
                if len(own) >= support and len(scores) >= support and sum(scores) / len(own) >= trust:
                    trusted[c, kind] = sum(scores) / len(own)
        new = {}
        for (c, i), own in shapes.items():
            for kind in own:
                if (c, kind) in trusted and (c, i) not in seeds:
                    new.setdefault((i, kind), []).append(trusted[c, kind])
        fresh = {}
        for x, confidences in new.items():
            doubt = 1.0
            for p in confidences:
                doubt *= 1.0001 - p
            if 1 - doubt >= trust and x not in known:
                fresh[x] = 1 - doubt
        if not fresh:
            return trusted
        known |= fresh


def graph_corpus(seed):
    rng = random.Random(seed)
    leads = ["call me at", "reach me via", "phone line is", "my number:", "it cost about", "ticket no"]
    out = []
    for k in range(160):
        lead = rng.choice(leads)
        n = rng.randrange(18)
        real = f"+1 (555) 010-{1000 + n}" if n < 15 else f"555-01{n:02d}-{2000 + n}"
        noise = f"77{rng.randrange(1000, 9999)}-{rng.randrange(100, 999)}"
        out.append(f"{rng.choice(['well', 'so', 'please'])} {lead} {noise if lead == 'it cost about' or rng.random() < 0.03 else real} {rng.choice(['today', 'soon', ''])}")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_equals_brute_force(spark, seed):
    texts = graph_corpus(seed)
    want = brute_known(texts, 3, 0.8)
    rows = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).selectExpr("inline(mentions)")
    got = {(r.context, r.kind): r.confidence for r in pii.trusted_contexts(rows).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_found_identifiers_lift_new_contexts(spark):
    """The second context never holds a seed; only numbers found through the first one are known in it."""
    first = [f"so call me at +1 (555) 010-{1000 + k} today" for k in range(28)]
    bridge = [f"so call me at 555-{k}23-4567 today" for k in range(1, 7)]
    second = [f"the desk line is 555-{k}23-4567 now" for k in range(1, 7)]
    last = "the desk line is 555-999-0000 now"
    docs = spark.createDataFrame(list(enumerate([*first, *bridge, *second, last])), "doc_id long, text string")
    row = pii.find(docs).withColumn("spans", pii.spans_column()).where("doc_id = 40").first()
    at = last.index("555")
    assert row.spans == f"phone:{at}:{at + 12}"


def test_long_tokens_and_contexts_are_whole():
    lead = "w" * 500
    text = f"a {lead} 5551234567{'0' * 90} end"
    (m,) = pii.mentions_of(text, [])
    assert m["end"] - m["start"] == 100 and m["instance"] == pii.sha(text[m["start"] : m["end"]])
    assert m["contexts"][1] == pii.sha(f"2 a {lead}")
    other = pii.mentions_of(text.replace("0 end", "1 end"), [])[0]
    assert other["instance"] != m["instance"] and other["contexts"] == m["contexts"]
    crowded = "a4111111111111111" * 20_000
    assert len(pii.mentions_of(crowded, pii.base_spans(crowded))) == 20_000


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, row int")
    assert pii.find(docs).count() == 1 and pii.find(docs.limit(0)).count() == 0


def test_redaction():
    text = "mail a@b.co or +1 (555) 010-1000"
    assert pii.redacted(text, pii.base_spans(text)) == "mail [EMAIL] or [PHONE]"
