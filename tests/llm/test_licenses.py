import math
import re
import textwrap
from dataclasses import replace

import pytest

from lectern.functions.text import STOP_WORDS
from lectern.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark)


def grams(text):
    words = re.findall("[a-z0-9]+", text.lower())
    telling = {w for w in words if len(w) > 2 and w not in STOP_WORDS}
    return telling | {" ".join(words[k : k + n]) for n in (2, 3) for k in range(len(words) - n + 1)}


def verdict(unit, model):
    """(family, probability, similarity) of a confirmed paragraph or line, else None."""
    own = grams(unit)
    known = [g for g in own if g in model.weights]
    if not known:
        return None
    allowed = {model.own[g] for g in known if g in model.own} | {len(model.families) - 1}
    z = [((b + sum(model.weights[g][k] for g in known)) if k in allowed else licenses.BARRED) / model.temperature for k, b in enumerate(model.bias)]
    p = 1 / sum(math.exp(x - max(z)) for x in z)
    family = model.families[z.index(max(z))]
    if family == licenses.UNKNOWN or p < model.threshold:
        return None
    places = 3 * len(re.findall("[a-z0-9]+", unit.lower())) - 3
    like = 0
    for t in map(grams, licenses.TEMPLATES[family]):
        common = len(own & t)
        of_template, of_paragraph = common / len(t), common / max(places, common, 1)
        if common > 1 and (of_template >= (licenses.CONFIRM if len(t) >= licenses.SHORT else licenses.CLOSE) or of_paragraph >= licenses.CLOSE):
            like = max(like, of_template, of_paragraph)
    return (family, p, like) if like else None


def blocks(text):
    return [b for b in re.split(licenses.BREAK, text or "") if b.strip()]


def brute(text, model):
    """Confirmed (family, probability) of each paragraph of a text."""
    return [v[:2] for b in blocks(text) if (v := verdict(b, model))]


def texts():
    every = [t for many in licenses.TEMPLATES.values() for t in many]
    out = every + licenses.NEGATIVES + [None, "", "\n\n", "license", "This is the MIT thing", "Licensed under CC BY-NC 4.0.\nno\nReleased under the MIT License."]
    return out + ["word " * 5000 + every[0], "prose\n" + every[3] + "\n" + every[7], every[1], every[1]]


def test_equals_brute_force(spark, model):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "Released under the MIT License.", "y")]
    out = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, family string"), model).collect()}
    assert len(out) == len(rows)
    for doc, text, _ in rows:
        want, got = brute(text, model), out[doc]
        assert got.n_licensed == len(want) and got.families == ",".join(sorted({f for f, _ in want})), (text, want, got)
        assert got.n_paragraphs == len(blocks(text))
        if want:
            assert got.probability == pytest.approx(max(p for _, p in want))


def test_finds_families_and_leaves_prose(spark, model):
    notes = [(k * 100 + j, t, f) for k, (f, many) in enumerate(sorted(licenses.TEMPLATES.items())) for j, t in enumerate(many)]
    found = {r.doc_id: r.family for r in licenses.scan_documents(spark.createDataFrame(notes, "doc_id long, text string, f string"), model).collect()}
    right = sum(found[d] == f for d, _, f in notes)
    assert right >= 0.9 * len(notes)
    prose = [(k, t) for k, t in enumerate(licenses.NEGATIVES)]
    assert licenses.scan_documents(spark.createDataFrame(prose, "doc_id long, text string"), model).where("family is not null").count() == 0


def scanned(spark, model, texts):
    rows = licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    return [r.family for r in sorted(rows, key=lambda r: r.doc_id)]


def test_short_notices_and_unlisted_wordings(spark, model):
    notices = {
        "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
        "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge": "mit",
        "The source code is available under the terms of the Apache License, Version 2.0.": "apache",
        "One line of prose.\nThen more of it.\nAll rights reserved.\nAnd an end.": "proprietary", "Mit.": None,
    }
    assert scanned(spark, model, notices) == list(notices.values())


def test_licence_words_in_prose_and_families_of_shared_words(spark, model):
    lesser = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    cases = {
        "The rights reserved by the tenant are listed below.": None, "No rights reserved. The board met again on Monday.": None,
        "Use of this source code is governed by the village council.": None, lesser: "lgpl", lesser.replace("Lesser ", ""): "gpl", lesser.replace("Lesser", "Affero"): "agpl",
        "Permission is hereby granted, free of charge, to the guests of the hotel.": None, "Licensed under the GNU Lesser General Public License, version 2.1.": "lgpl",
    }
    assert scanned(spark, model, cases) == list(cases.values())


def test_held_out_reliability(spark, model):
    """Of held-out paragraphs reported at some probability, at least nine tenths of it are right."""
    held = [r for r in licenses.training_paragraphs() if r["held"]]
    got = [verdict(r["text"], model) for r in held]
    reported = [(v[1], v[0] == r["family"]) for v, r in zip(got, held) if v]
    assert sum(r["family"] == licenses.UNKNOWN for r in held) >= 80
    assert sum(right for _, right in reported) >= 0.9 * sum(p for p, _ in reported)
    assert sum(v is not None for v, r in zip(got, held) if r["family"] == licenses.UNKNOWN) <= 0.02 * len(held)


def test_hard_wrapped_grant_is_one_paragraph(spark, model):
    grant = licenses.TEMPLATES["mit"][0]
    wrapped = "\n".join(textwrap.wrap(grant, 60))
    docs = spark.createDataFrame([(1, grant), (2, wrapped), (3, f"Intro.\n \n{wrapped}\n\nEnd.")], "doc_id long, text string")
    rows = sorted(licenses.scan_documents(docs, model).collect())
    assert [r.family for r in rows] == ["mit"] * 3 and [r.n_licensed for r in rows] == [1] * 3 and rows[2].n_paragraphs == 3
    assert rows[0].probability == pytest.approx(rows[1].probability)


def test_ties_go_to_the_alphabetically_first(spark, model):
    even = {g: [1.0] * (len(model.families) - 1) + [0.0] for g in model.weights}
    flat = replace(model, weights=even, bias=[0.0] * len(model.families), threshold=0.0)
    names = ["mpl", "mit", "cc-by-sa", "cc-by", "cc-by-nc"]
    text = "\n\n".join(licenses.TEMPLATES[n][1] for n in names)
    rows = licenses.scan_paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"), flat).collect()
    assert {r.family for r in rows} <= set(names)  # each names itself, and only those are compared
    both = scanned(spark, flat, ["Licensed under the MIT License. Licensed under the ISC license. Licensed under the LGPL v2.1"])
    assert both == ["isc"]
    docs = spark.createDataFrame([(1, "\n\n".join(licenses.TEMPLATES["mit"][3:5] * 2))], "doc_id long, text string")
    assert [r.family for r in licenses.scan_documents(docs, model).collect()] == ["mit"]


def test_repeated_rows_do_not_add_up(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * 300 + [(2, "the license of the fish")] * 300, "doc_id long, text string")
    rows = {tuple(r) for r in licenses.scan_documents(docs, model).collect()}
    assert len(rows) == 2


def test_empty(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_documents(docs, model).count() == 0


def test_plan_is_native(spark, model):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = licenses.scan_documents(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
