"""Alignment of two public tokenizers' tokens over the same bytes.

Each byte of a text gets a label: 0, 1 where a token of A ends, 2 where one of B ends, 3 where
both end. A regular expression takes spans up to each 3 from the string of labels, and the
counts of 1 and 2 in a span say how many tokens of A and of B it groups. The last tokens of a
group, which end together, are linked.

A is a byte-level BPE that reads a space and the text; B is a SentencePiece BPE that puts the
space there itself. Neither has a token that reaches from a character that is not white space
over a following space (A by its splitting rule, B by its pieces; both are checked when they
are loaded), so texts are cut there into words, each word is aligned once, and its groups are kept: new words of a batch are
strung together and encoded in one call. Words are only cut behind characters that every
tokenizer takes for no white space. A text of plain characters goes through a fast encoder of
A's ranks, as its splitting rule has no doubtful case there, any other through A's library.

Counts of linked id pairs: each row carries its own pairs, in number; Spark sums them over
the corpus, and the sums go to all tasks. That is bounded by the vocabularies: of two tokens
that end at one byte the shorter one's bytes end the longer one's, so there are at most as
many pairs as tokens have bytes, twice over for bytes that two tokens of B share.

Defined cases: null and empty texts, and texts that one of the tokenizers does not give back
byte for byte, have no tokens; repeated rows each keep their own row and all count; a null
doc_id keeps its row; strings of special tokens are plain text; other columns are not looked
at; an empty table gives an empty result; a text is held as its words, and one word, however
long, is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.arrow import column, keyed_texts, map_rows, texts
from lectern.runtime import written

#: Characters after which a text may be cut: no kind of white space, whoever says what that is.
_SOLID = r"[^\s\x00-\x20\x7f-\xa0 ᠎ -⁯　﻿]"
_BETWEEN = re.compile(rf"(?<={_SOLID}) (?=.)", re.DOTALL)
_SOLID_END = re.compile(_SOLID)
_PLAIN = re.compile("[ \n!-~À-ÖØ-öø-ÿ]*")
# Fixed value: the splitting rule of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPAN = re.compile(b"[012]*3")
#: Characters of new words encoded in one call, of a word that is kept, and kept words of each of two generations.
CALL, KEPT, WORDS = 1 << 16, 48, 80_000


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteSide:
    """A: token ids of texts and the bytes of each id."""

    def __init__(self, data: str):
        self.library = Tokenizer.from_str(data)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        spec, of = json.loads(data), _byte_of_character()
        size = self.library.get_vocab_size()
        self.bytes: list[bytes] = [b""] * size
        special = {t["id"] for t in spec["added_tokens"]}
        for token, k in spec["model"]["vocab"].items():
            self.bytes[k] = token.encode() if k in special else bytes(of[c] for c in token)
        if not _splits_alike(spec):
            raise ValueError("A has another splitting rule, whose tokens may reach over the space between words")
        ranks = {b: k for k, b in enumerate(self.bytes) if k not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Ranks say the same as the list of merges if each merge makes the next id.
        in_order = len(merges) == len(ranks) - 256 and all(self.bytes[256 + k] == bytes(of[c] for c in x + y) for k, (x, y) in enumerate(merges))
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def _splits_alike(spec: dict) -> bool:
    """Whether the tokenizer file has the byte-level splitting rule, alone."""
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class PieceSide:
    """B: token ids of texts, which it begins with a space, and the bytes of each id."""

    def __init__(self, data: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.vocab_size())]
        plain = [not (self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_byte(k)) for k in range(len(pieces))]
        if any(re.search("[^▁]▁", p) for p, ok in zip(pieces, plain) if ok):
            raise ValueError("a piece of B reaches over the space between words")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class Word(NamedTuple):
    """Groups of one word: counts, the groups written out, and the linked pairs (A id << 32 | B id) as bytes."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


class Aligner:
    """Two tokenizers and a cache of aligned words."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteSide(a), PieceSide(b)
        self.lengths = [np.array([len(x) for x in side.bytes]) for side in (self.a, self.b)]
        self.names = list(map(str, range(max(len(self.a.bytes), len(self.b.bytes)))))
        self.kept: dict[str, Word | None] = {}
        self.old: dict[str, Word | None] = {}

    def labels(self, a: list[int], b: list[int], n: int) -> bytes:
        """The label string of n bytes."""
        out = np.full(n, ord("0"), np.uint8)
        for ids, lengths, mark in ((a, self.lengths[0], 1), (b, self.lengths[1], 2)):
            out[np.cumsum(lengths[ids]) - 1] += np.uint8(mark)
        return out.tobytes()

    def _aligned(self, joined: str, ends: list[int]) -> Iterator[Word] | None:
        """The words of a space and ``joined``, which end at these bytes; None if the bytes are not given back."""
        a, b, raw = self.a.encode(f" {joined}"), self.b.encode(joined), f" {joined}".encode()
        if b"".join([self.a.bytes[k] for k in a]) != raw or b"".join([self.b.bytes[k] for k in b]) != raw:
            return None
        return self._words(a, b, self.labels(a, b, len(raw)), ends)

    def _words(self, a: list[int], b: list[int], labels: bytes, ends: list[int]) -> Iterator[Word]:
        spans = _SPAN.findall(labels)
        stop = np.cumsum([len(span) for span in spans])
        last, sides = [], []
        for ids, mark in ((a, b"1"), (b, b"2")):
            n = np.array([span.count(mark) for span in spans]) + 1
            upto = np.cumsum(n)
            names = [self.names[k] for k in ids]
            own = [names[k] for k in (upto - 1).tolist()]
            for g in np.flatnonzero(n > 1).tolist():
                own[g] = ",".join(names[upto[g] - n[g] : upto[g]])
            last.append(upto)
            sides.append(own)
        groups = [f"{x}|{y}" for x, y in zip(*sides)]
        links = ((np.array(a, np.int64)[last[0] - 1] << 32) | np.array(b, np.int64)[last[1] - 1]).tobytes()
        at = np.searchsorted(stop, ends)
        assert (stop[at] == ends).all(), "a token reaches over the space between words"
        places = zip((at + 1).tolist(), last[0][at].tolist(), last[1][at].tolist())
        g0 = i0 = j0 = 0
        for g, i, j in places:
            yield Word(i - i0, j - j0, g - g0, ";".join(groups[g0:g]), links[8 * g0 : 8 * g])
            g0, i0, j0 = g, i, j

    def _learn(self, words: list[str], out: dict[str, Word | None]) -> None:
        """Aligns words that end in no white space, strung together; one by one if together they are not given back."""
        sizes = np.cumsum([len(w.encode()) + 1 for w in words]).tolist()
        found = self._aligned(" ".join(words), sizes)
        if found is not None:
            out.update(zip(words, found))
        elif len(words) == 1:
            out[words[0]] = None
        else:
            for k in (0, len(words) // 2):
                self._learn(words[k : k + max(1, len(words) // 2)] if not k else words[k:], out)

    def words(self, parts: list[list[str]]) -> dict[str, Word | None]:
        """The alignment of each word of some texts; None for words that are not given back."""
        if len(self.kept) > WORDS:
            self.old, self.kept = self.kept, {}
        out: dict[str, Word | None] = {}
        new: dict[bool, list[str]] = {True: [], False: []}
        for word in set().union(*parts):
            known = self.kept.get(word, 0)
            if known == 0:
                known = self.old.get(word, 0)
                if known == 0:
                    if len(word) > CALL or not _SOLID_END.match(word[-1:]):
                        self._learn_alone(word, out)
                    else:
                        new[_PLAIN.fullmatch(word) is not None].append(word)
                    continue
                self.kept[word] = known
            out[word] = known
        for fresh in new.values():
            held, size = [], 0
            for word in fresh:
                held.append(word)
                size += len(word)
                if size > CALL:
                    self._learn(held, out)
                    held, size = [], 0
            if held:
                self._learn(held, out)
            self.kept.update((w, out[w]) for w in fresh if len(w) <= KEPT)
        return out

    def _learn_alone(self, word: str, out: dict[str, Word | None]) -> None:
        found = self._aligned(word, [len(word.encode()) + 1])
        out[word] = next(found) if found is not None else None


def cut_words(text: str) -> list[str]:
    """A text's words; joined by spaces they are the text."""
    return _BETWEEN.split(text)


_BLANK = {"n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "groups_sha256": "", "pairs": [], "times": []}


def groups_of(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups (null unless kept), groups_sha256, and pairs with times: linked ids (A id << 32 | B id) and how often.

    The paths are of the driver; the files are sent to the tasks.
    """
    sc = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = sc.broadcast((f.read(), base64.b64encode(g.read())))  # two vocabulary files

    def per_task() -> Callable[[pa.RecordBatch], dict]:
        aligner = Aligner(files.value[0], base64.b64decode(files.value[1]))

        def one(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in _BLANK}
            held, size = [], 0
            for text in texts(batch):
                held.append(cut_words(text) if text else [])
                size += len(text)
                if size > 4 * CALL:
                    _add(out, aligner, held, keep_groups)
                    held, size = [], 0
            _add(out, aligner, held, keep_groups)
            return {"row": column(batch, "row"), "doc_id": column(batch, "doc_id")} | out

        return one

    ddl = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, pairs array<long>, times array<int>"
    return map_rows(keyed_texts(docs).withColumn("row", F.monotonically_increasing_id()), per_task, ddl)


def _add(out: dict[str, list], aligner: Aligner, parts: list[list[str]], keep_groups: bool) -> None:
    """Appends the columns of some texts, given as words."""
    known = aligner.words(parts) if parts else {}
    for words in parts:
        row = dict(_BLANK)
        found = [known[w] for w in words]
        if found and None not in found:
            n_a, n_b, n_groups, groups, links = zip(*found)
            joined = ";".join(groups)
            pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            row = {"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "groups": joined, "groups_sha256": hashlib.sha256(joined.encode()).hexdigest(), "pairs": pairs, "times": times}
        row["groups"] = row["groups"] if keep_groups else None
        for k, values in out.items():
            values.append(row[k])


def pair_counts(grouped: DataFrame) -> DataFrame:
    """pair, total (links of the corpus that hold it) and best (no pair of its B id has more)."""
    links = grouped.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    totals = links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("total"))
    most = totals.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("total").alias("most"))
    both = totals.join(most, F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)) == F.col("b"))
    return both.select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups (null unless kept) of every row."""
    grouped = written(groups_of(docs, a_path, b_path, keep_groups))
    counts = written(pair_counts(grouped))
    links = grouped.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    # At most as many pairs as the tokens of both vocabularies have bytes, twice.
    met = links.join(F.broadcast(counts), "pair")
    # A row's pairs are made in one task, so they are summed there before anything travels; sums of numbers alone need no sort.
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    sums = met.groupBy("row").agg(F.sum("times").alias("n_links"), best.alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    out = grouped.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256", "groups")
