import random
import re
from itertools import combinations

import numpy as np
import pytest

from lectern.llm import components, neardup


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[find(j)] = find(i)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((doc, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdEé") for _ in range(rng.randrange(1, 5)))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([1, 2, 3, 4, 5, 60, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append(rng.choice([" ", "  ", "\n"]).join(w))
    rows += ["", None, "  ", "a b c", "A b\tc"]
    rng.shuffle(rows)
    out = [(k * 3 % 101 + 1000 * (k // 101), t) for k, t in enumerate(rows)]
    return out + [(None, out[0][1]), out[1]]


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3)])
def test_equals_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = neardup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, th string")
    assert neardup.near_duplicates(docs).count() == 0


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, neardup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(neardup.CHUNKS * neardup.WIDTH, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)] += 1
        assert (neardup.entries(a) == neardup.entries(b)).any()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(60):
        x = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
        y = np.unique(np.concatenate([x[:400], rng.integers(0, 1 << 63, 0, dtype=np.uint64)]))
        same.append((neardup.signature(x) == neardup.signature(y)).mean())
    assert abs(np.mean(same) - 0.8) < 0.02


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len({r.node for r in got})


def test_no_guaranteed_pair_is_left_out():
    """Pairs at the distance threshold are joined however much the symbols beyond it differ."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(neardup.CHUNKS * neardup.WIDTH, neardup.NEAR, replace=False)] += 1
        b[neardup.CHUNKS * neardup.WIDTH :] += 1
        assert neardup.near_pairs(np.array([a, b])).roots().tolist() == [0, 0]


def test_links_at_the_least_similarity_are_found():
    """Of pairs of sets at a similarity of exactly 0.8, next to none share no entry or are too far apart."""
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(2000):
        x = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        pair = np.array([neardup.signature(np.unique(x[:81])), neardup.signature(np.unique(x[9:]))])  # 72 of 90 in both
        shared = (neardup.entries(pair[:1]) == neardup.entries(pair[1:])).any()
        missed += not (shared and neardup.near_pairs(pair).roots().tolist() == [0, 0])
    assert missed <= 2
