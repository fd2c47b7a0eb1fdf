import hashlib
import random

import numpy as np
import pytest

from lectern.llm import suffix


def brute(rows, length):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if doc is not None:
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if doc is not None and first[raw[k : k + length]] < doc:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abcdé", "the of and in "][seed % 3]
    fresh = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [fresh(rng.choice([49, 50, 51, 60, 120, 300])) for _ in range(6)]
    texts = []
    for _ in range(50):
        t = "".join(rng.choice([fresh(rng.randrange(40)), rng.choice(shared), rng.choice(shared)[3:]]) for _ in range(rng.randrange(6)))
        texts.append(t)
    texts += ["", None, "x" * 49, "x" * 50, "x" * 51, "x" * 300, texts[3], texts[3], shared[5] * 5, "\0" * 80, "\0" * 70 + "a"]
    rng.shuffle(texts)
    rows = list(zip(rng.sample(range(-40, 400), len(texts)), texts))
    return rows + [(None, shared[5]), (rows[4][0], rows[5][1]), rows[6]]


@pytest.mark.parametrize("seed,piece", [(0, 1 << 22), (1, 1 << 22), (2, 1 << 22), (1, 130)])
def test_equals_brute_force(spark, seed, piece, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", piece)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "tag")
    out = suffix.deduplicated(docs).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 50)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, tag int")
    assert suffix.deduplicated(docs).count() == 0


def test_multikey_sort_classes():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, depth = int(rng.integers(1, 300)), int(rng.integers(1, 5))
        x = rng.integers(0, 3, (n, depth)).astype(np.uint64)
        first = rng.integers(0, 4, n)
        order, starts = suffix.multikey_sort(first, lambda k, level: x[k, level], np.full(n, depth))
        keys = [(int(first[k]), *map(int, x[k])) for k in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        assert starts.tolist() == [k for k in range(n) if k == 0 or keys[k] != keys[k - 1]]
