import random
import re
import time

import numpy as np
import pytest

from lectern.llm import decontaminate as dc
from lectern.llm.arrow import sha

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window):
    wins = []
    for name, text in items:
        w = tokens(text)
        if w:
            wins += [(name if name is None else str(name), tuple(w[k : k + window])) for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        w, hit, names = tokens(text), set(), set()
        for name, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names |= {name} - {None}
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("passes", [32, 2])
def test_equals_brute_force(spark, passes, monkeypatch):
    monkeypatch.setattr(dc, "PASS_BLOCKS", passes)
    monkeypatch.setattr(dc, "KEEP", 2)
    rng = random.Random(3)
    for window in (2, 3, 13) if passes > 2 else (3,):
        word = lambda: rng.choice(["a", "B", "c", "é", "D1", "É"])
        items = [(k, " ".join(word() for _ in range(rng.randrange(0, 2 * window)))) for k in range(8)] + [(8, None), (9, "..."), (1, "zz a"), (None, "c é a b c é b b a c c é a b a a")]
        docs = [(k, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(0, 40)))) for k in range(60)]
        docs += [(100, None), (101, ""), (102, " ".join(f"q{k}" for k in range(400)) + " " + (items[0][1] or "")), (3, docs[3][1])]
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
        b = spark.createDataFrame(items, "item_id long, text string")
        for block in (5, 10**6) if passes > 2 else (25,):
            got = dc.scan_documents(d, b, window=window, block_words=block).drop("spans").collect()
            assert sorted(map(tuple, got)) == sorted(brute(docs, items, window))


def test_an_automaton_is_unpacked_once_for_the_texts_of_a_call():
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(30)
    items = [(str(k), " ".join(word() for _ in range(40))) for k in range(3 * dc.KEEP)]
    docs = [(k, " ".join(word() for _ in range(60)) + " " + items[k % len(items)][1][: 5 * k]) for k in range(50)]

    class Sent:
        def __init__(self, item):
            self.value = dc.packed(dc.SuffixAutomaton([(item[0], dc.words_of(item[1]))], 3))

    held = dc._Held([Sent(i) for i in items])
    assert held.gather
    before = dc.unpacked.cache_info().misses
    hits, names = held.hits([t for _, t in docs])
    assert dc.unpacked.cache_info().misses - before == len(items)
    assert dc.unpacked.cache_info().currsize <= dc.KEEP
    got = [(d, len(h), int(h.sum()), len(n), sha(",".join(sorted(n))), dc.is_contaminated(int(h.sum()), len(h))) for (d, _), h, n in zip(docs, hits, names)]
    assert got == brute(docs, items, 3)


def test_pieces_of_long_items_hold_the_same_windows():
    for n in (1, 12, 13, 14, 30, 31, 199, 200, 201):
        words = [b"%d" % k for k in range(n)]
        for most in (1, 104, 160, 10**6):
            pieces = list(dc._pieces(words, 13, most))
            windows = [tuple(p[k : k + 13]) for p in pieces for k in range(max(1, len(p) - 12))]
            assert windows == [tuple(words[k : k + 13]) for k in range(max(1, n - 12))]


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    row = dc.scan_documents(d, none).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated, row.spans) == (2, 0, 0, False, [])
    assert dc.scan_documents(d.limit(0), none).count() == 0


def test_spans_are_cut_out_below_the_coverage_limit(spark):
    item = "Alpha beta, gamma delta"
    body = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, f"{body} (alpha BETA gamma; delta). {body}", 7), (2, "so alpha beta gamma delta", 8), (3, body, 9), (4, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in dc.filtered(docs, bench, "doc_id long, text string, n_chars long", window=4).collect()}
    assert set(rows) == {1, 3, 4}
    assert rows[1].text == f"{body} (). {body}" and rows[1].n_chars == len(rows[1].text)
    assert tuple(rows[3]) == (3, body, 9) and tuple(rows[4]) == (4, None, None)


def test_long_and_repetitive_texts_are_linear():
    took = []
    for n in (20_000, 40_000):
        automaton = dc.SuffixAutomaton([("a", [b"x"] * n), ("b", [b"x", b"y"] * (n // 2))])
        began = time.process_time()
        hit, items = np.zeros(2 * n + 1, np.int64), set()
        automaton.scan([b"x", b"x", b"y", b"x"] * (n // 2), hit, items)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.2
