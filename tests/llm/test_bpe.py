import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import bpe
from lectern.llm.arrow import sha

PATH = public_tokenizers.path("word_bpe_49k.json")
E = bpe.Encoder(open(PATH, encoding="utf-8").read())
T = E.library
PIECES = ["a", "the ", "international", "'s", "''", "don't ", " ", "\n", "é", "é", "<|endoftext|>", "<|", "123", "!?", "Σ", "İ", "日本", "🙂", "‍", "aaaa"]


def whole(text):
    return T.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.integers(5, 60))
def test_tree_equals_whole(pieces, leaf):
    text = "".join(pieces)
    assert E.encode([text], leaf) == [whole(text)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("'sStTrReE <|>09\u0301\u212b")), max_size=40), st.integers(3, 50))
def test_any_text_equals_library(text, leaf):
    assert E.encode([text], leaf) == [whole(text)] and E.encode([text]) == [whole(text)]


def test_long_without_spaces():
    rng = random.Random(1)
    for alphabet in ("a", "ab", "etaoin", "0123", "!?"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        assert E.encode([text], 200) == [whole(text)]


def test_documents(spark):
    docs = [(1, "Hello <|endoftext|> World"), (2, None), (3, ""), (3, ""), (None, "x " * 20000)]
    out = bpe.encode_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    assert len(out) == 5
    for doc, text in docs:
        ids = whole(text or "")
        row = next(r for r in out if r.doc_id == doc)
        assert (row.n_tokens, row.ids) == (len(ids), ids) and row.ids_sha256 == sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == sha(T.decode(ids, skip_special_tokens=False))


BYTES = bpe.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
BLANKS = [*PIECES, "   ", "\n\n ", "\t", " 's", "  x", "x" * 30, " " * 40, "\u3000"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(BLANKS), max_size=120), st.integers(5, 60))
def test_byte_vocabulary_beyond_the_leaf(pieces, leaf):
    text = "".join(pieces)
    assert BYTES.by_bytes and BYTES.encode([text], leaf) == [BYTES.library.encode(text, add_special_tokens=False).ids]


def test_byte_vocabulary_on_a_long_text():
    rng = random.Random(3)
    text = "".join(rng.choice(BLANKS) for _ in range(12_000))
    assert len(text) > 3 * bpe.LEAF and BYTES.encode([text]) == [BYTES.library.encode(text, add_special_tokens=False).ids]


def test_other_tokenizers_encode_whole():
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"] = {"type": "Lowercase"}
    other = bpe.Encoder(json.dumps(spec))
    text = "Some  words, ".join(["x"] * 3000)
    assert not other.known and not other.by_bytes and other.encode([text]) == [other.library.encode(text, add_special_tokens=False).ids]


def parts_of(encoder, text, spread, leaf):
    cuts = range(0, len(text), spread)
    return iter([{"text": text[a : a + spread]} | bpe._packed(encoder.tree(text[a : a + spread], a, leaf)) for a in cuts])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BLANKS), max_size=160), st.integers(20, 90), st.integers(7, 40), st.booleans())
def test_parts_equal_whole(pieces, spread, leaf, by_bytes):
    text = "".join(pieces)
    t = BYTES if by_bytes else E
    assert bpe.joined_parts(t, parts_of(t, text, spread, leaf), leaf) == t.library.encode(text, add_special_tokens=False).ids


def test_parts_without_a_boundary(spark):
    rng = random.Random(5)
    for text in ("a" * 3000, "".join(rng.choice("abcd") for _ in range(3000)), "!?" * 1500, "日本" * 900):
        assert bpe.joined_parts(E, parts_of(E, text, 300, 100), 100) == whole(text)


def test_spread_documents(spark):
    rng = random.Random(6)
    long = ["".join(rng.choice(BLANKS) for _ in range(n)) for n in (400, 900, 2500)] + ["x" * 900, "word " * 500]
    docs = [(k, t) for k, t in enumerate(long)] + [(0, long[0]), (0, long[1]), (None, long[2]), (90, "short"), (91, None)]
    for path, t in ((PATH, T), (public_tokenizers.path("byte_bpe_50k.json"), BYTES.library)):
        out = bpe.encode_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")), path, leaf=150, spread=400).collect()
        want = [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x in docs]
        assert sorted(((r.doc_id, r.ids) for r in out), key=str) == sorted(want, key=str)
