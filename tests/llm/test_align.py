"""Groups against whole-text encodings by the libraries, and the query against plain Python."""

import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import align, queries
from lectern.llm.arrow import sha

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def byte_of():
    return align._byte_of_character()


def brute(text, sides, byte_of):
    """Groups of ids (A, B) of a whole text, by plain loops; none if the bytes differ."""
    if not text:
        return []
    a, b = sides
    raw = f" {text}".encode()
    one = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in a.encode(f" {text}", add_special_tokens=False).ids]
    two = []
    for k in b.encode(text):
        piece = b.id_to_piece(k)
        two.append((k, bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in one) != raw or b"".join(x for _, x in two) != raw:
        return []
    ends = [set(), set()]
    for side, tokens in enumerate((one, two)):
        at = 0
        for _, x in tokens:
            at += len(x)
            ends[side].add(at)
    cuts, groups = sorted(ends[0] & ends[1]), []
    for low, high in zip([0, *cuts], cuts):
        group = []
        for tokens in (one, two):
            at, inside = 0, []
            for k, x in tokens:
                at += len(x)
                if low < at <= high:
                    inside.append(k)
            group.append(inside)
        groups.append(group)
    return groups


def shown(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


PIECES = ["a", " ", "  ", "\n", "the", " Word", "don't", "é", "ñ", "ß", "🙂", "▁", "<|endoftext|>", "</s>", "\t", "123", "...", "é", " ", "᠎", " ", "中文", "\x1c", "'ll", "\x00", "\r\n", "ſ", "Ⅷ", "½", "　", "﻿", "\u0085", "​"]


def test_words_equal_whole_texts(sides, byte_of):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = align.Aligner(f.read(), g.read())
    rng, given = random.Random(5), 0
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14)))
        words = align.cut_words(text)
        assert " ".join(words) == text
        found = [aligner.words([words])[w] for w in words]
        want = brute(text, sides, byte_of)
        if want:
            given += 1
            assert ";".join(x.groups for x in found) == shown(want), repr(text)
        else:
            assert None in found, repr(text)
    assert given > 700


def rows_of(docs, sides, byte_of):
    groups = {k: brute(t, sides, byte_of) for k, t in docs}
    links = {k: [(a[-1], b[-1]) for a, b in g] for k, g in groups.items()}
    count = Counter(x for own in links.values() for x in own)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return {
        k: (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links[k]), sum(count[x] == most[x[1]] for x in links[k]), sum(count[x] for x in links[k]), sha(shown(g)) if g else "")
        for k, g in groups.items()
    }


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_query_equals_brute_force(spark, tmp_path, sides, byte_of):
    from lectern.runtime import load

    docs = [(r.doc_id, r.text) for r in load(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 1500").select("doc_id", "text").collect()]
    rng = random.Random(8)
    docs += [(10_000 + k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(30)))) for k in range(100)]
    docs += [(20_000, None), (20_001, ""), (None, "null id"), (20_002, " "), (20_003, "trailing "), (20_004, "x" * 3_000), (20_005, "many words " * 4_000)]
    rows = [(k, t, "en", "s", 1) for k, t in docs]
    spark.createDataFrame(rows, DDL).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_align(spark, str(tmp_path)).collect()
    # Long texts by their words' counts, as plain loops over them would take minutes.
    small = [(k, t) for k, t in docs if k != 20_005]
    assert len(out) == len(docs)
    long = next(r for r in out if r.doc_id == 20_005)
    assert long.n_links == long.n_groups and long.n_a >= 8_000
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out}
    want = rows_of(small + [(20_005, "many words " * 40)], sides, byte_of)
    for k, _ in small:
        assert found[k][:4] == want[k][:4] and found[k][6] == want[k][6], k
    # All counts, without the long text.
    spark.createDataFrame([r for r in rows if r[0] != 20_005], DDL).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_align(spark, f"{tmp_path}/b").collect()} == rows_of(small, sides, byte_of)


def test_edges(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_align(spark, str(tmp_path)).count() == 0
    twice = spark.createDataFrame([(1, "same words", 5, [1])] * 3, "doc_id long, text string, row int, pairs array<int>")
    out = align.align_documents(twice, A, B).collect()
    assert len(out) == 3 and len({tuple(r) for r in out}) == 1 and out[0].count_sum == 3 * out[0].n_links and out[0].groups


def test_pairs_are_bounded_by_the_vocabularies():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = align.Aligner(f.read(), g.read())
    assert aligner.a.fast is not None
    assert sum(map(len, aligner.a.bytes)) + sum(map(len, aligner.b.bytes)) < 1_000_000
