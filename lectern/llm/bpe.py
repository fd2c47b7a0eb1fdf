"""BPE encoding and decoding with a public tokenizer file, long texts by tree concatenation.

A text of more than ``leaf`` characters is cut into leaves at fixed places, whatever
stands there, and each leaf is encoded on its own. Neighbours are then joined pairwise up
a tree: a window around the join is encoded again, and grown, until on each side a run of
its pieces equals, in ids and place, the pieces that the halves have there; the join takes
the left pieces up to that run, the window's between the runs, and the right pieces after.
A window that reaches both ends is the whole text.

Why a join is exact: pieces are the tokenizer's words, or its tokens where a chunk needs the
library. Words follow from the text left to right, so two readings that begin a word at one
place go on alike. Of tokens, a sequence is the encoding of its text exactly if each token
and its neighbour are the encoding of theirs together; left of a common token all
neighbours are those of one encoding, right of it those of the other. One common piece away
from any cut is enough; RUN are asked for.

Halves of one text are encoded in parallel where it has more than SPREAD characters: its
parts are dealt to tasks as rows of their own, each encoded by its own tree, and joined in
the order of the text by one task, which holds the pieces near the join and packed ids for
the rest. Texts below that are encoded in one task each. Words are kept in a cache.

Defined cases: null is an empty text and has no tokens (hash of the empty string);
repeated rows and ids each keep their own row; other columns are not looked at; an empty
table gives an empty result. A tokenizer of another kind than the two known ones (words
between blanks, or bytes) encodes each text whole, in one call of its library.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer

from lectern.llm.arrow import column, keyed_texts, map_rows, sha, texts

LEAF = 16_384
#: Characters of a part that is a row of its own in a text of more than as many.
SPREAD = 1 << 16
#: Characters on each side of a join that are encoded again first, and pieces that must agree.
REACH, RUN = 48, 4
#: Texts handled at once, and words in each of the two generations of a worker's cache.
CALL, CACHE = 64, 50_000

#: Texts of these characters take the short way: but for case they are their own normal
#: form, one character each, so the tokenizer's normalizer and splitter have few cases.
_PLAIN = re.compile("[ \n!-~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")
_CHUNKS = re.compile("[^ \n]+")

#: A piece: (start, end, ids) of a stretch of text.
Piece = tuple[int, int, tuple[int, ...]]


def _byte_characters() -> dict[int, str]:
    """Translation of plain characters to the characters that stand for their UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Words(dict):
    """Ids of a plain word, kept once found; a full generation becomes the old one, from which words in use come back."""

    def __init__(self, model, ids: list[int]):
        self.model = model
        self.ids = ids  # one object for each number, whatever words hold it
        self.bytes = _byte_characters()
        self.old: dict[str, tuple[int, ...]] = {}

    def rotate(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or tuple([self.ids[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))])
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """A public tokenizer with a cache of words.

    The tokenizer drops blanks before it merges and its special strings hold none, so a
    text's ids are those of its chunks between blanks, in order. What is not plain goes
    through the library, chunk by chunk or whole.
    """

    def __init__(self, data: str):
        self.library = Tokenizer.from_str(data)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        spec = json.loads(data)
        self.known, self.by_bytes = _is_known(spec), _is_by_bytes(spec)
        self.words = _Words(self.library.model, list(range(self.library.get_vocab_size())))
        self.named = list(map(str, range(self.library.get_vocab_size())))

    def is_plain(self, text: str) -> bool:
        return self.known and _PLAIN.fullmatch(text) is not None and not self.special.search(text)

    def short(self, text: str) -> list[int]:
        """Ids of a text, word by word or chunk by chunk."""
        if self.is_plain(text):
            self.words.rotate()
            return list(chain.from_iterable(map(self.words.__getitem__, _WORDS.findall(text.lower()))))
        if not self.known:
            return self.library.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        odd: list[str] = []
        for chunk in _CHUNKS.findall(text):
            if not self.is_plain(chunk):
                odd.append(chunk)
                continue
            if odd:
                ids += self.library.encode(" ".join(odd), add_special_tokens=False).ids
                odd = []
            ids.extend(chain.from_iterable(map(self.words.__getitem__, _WORDS.findall(chunk.lower()))))
        if odd:
            ids += self.library.encode(" ".join(odd), add_special_tokens=False).ids
        return ids

    def pieces(self, text: str, base: int = 0) -> list[Piece]:
        """Pieces of a text that is cut at any place, with their places from ``base``."""
        words = self.words
        words.rotate()
        if not self.known:
            e = self.library.encode(text, add_special_tokens=False)
            return [(base + a, base + b, (i,)) for i, (a, b) in zip(e.ids, e.offsets)]
        if self.is_plain(text):
            return [(base + m.start(), base + m.end(), words[m.group()]) for m in _WORDS.finditer(text.lower())]
        out: list[Piece] = []
        for c in _CHUNKS.finditer(text):
            at = base + c.start()
            if self.is_plain(c.group()):
                out += [(at + m.start(), at + m.end(), words[m.group()]) for m in _WORDS.finditer(c.group().lower())]
            else:
                e = self.library.encode(c.group(), add_special_tokens=False)
                out += [(at + a, at + b, (i,)) for i, (a, b) in zip(e.ids, e.offsets)]
        return out

    def tree(self, text: str, base: int, leaf: int) -> list[Piece]:
        """Pieces of a text, with their places from ``base``, by tree concatenation."""
        cuts = [*range(0, len(text), leaf), len(text)]
        level = [(a, b, self.pieces(text[a:b], a)) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            above = [(a, d, self.join(text, x, y, a, b, d)) for (a, b, x), (_, d, y) in zip(level[::2], level[1::2])]
            level = above + level[len(above) * 2 :]
        return [(a + base, b + base, ids) for a, b, ids in level[0][2]] if level else []

    def long(self, text: str, leaf: int = LEAF) -> list[int]:
        """Ids of a long text by tree concatenation."""
        return [i for _, _, ids in self.tree(text, 0, leaf) for i in ids]

    def join(self, text: str, left: list[Piece], right: list[Piece], start: int, at: int, stop: int, more: bool = False) -> list[Piece] | None:
        """Pieces of text[start:stop] from those of text[start:at] and text[at:stop].

        more: there is text before ``start`` that is not at hand; null if it would be needed.
        """
        reach = REACH
        while True:
            a, b = max(start, at - reach), min(stop, at + reach)
            if more and a == start:
                return None
            window = self.pieces(text[a:b], a)
            near = left[-4 * reach :]
            # Away from the window's own cuts and from the halves' cut, pieces can settle.
            head = (0, -len(near)) if a == start else agree(window, near, a + reach // 4, at - reach // 4, last=False)
            tail = (len(window), len(right)) if b == stop else agree(window, right[: 4 * reach], at + reach // 4, b - reach // 4, last=True)
            if head and tail and head[0] <= tail[0]:
                before = [] if a == start else left[: len(left) - len(near) + head[1]]
                return before + window[head[0] : tail[0]] + right[tail[1] :]
            reach *= 2

    def encode(self, many: list[str], leaf: int = LEAF) -> list[list[int]]:
        """Ids of each text, as the library encodes it without special tokens."""
        return [self.long(x, leaf) if len(x) > leaf and (self.known or self.by_bytes) else self.short(x) for x in many]


def agree(window: list[Piece], side: list[Piece], low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Indices (in window, in side) where RUN equal pieces within [low, high] begin, or end for the last such run."""
    where = {p: k for k, p in enumerate(side) if p[0] >= low and p[1] <= high}
    for w in range(len(window) - RUN, -1, -1) if last else range(len(window) - RUN + 1):
        s = where.get(window[w])
        if s is not None and window[w : w + RUN] == side[s : s + RUN] and side[s + RUN - 1][1] <= high:
            return (w + RUN, s + RUN) if last else (w, s)
    return None


def _is_known(spec: dict) -> bool:
    """Whether the tokenizer normalizes and splits as the short way for plain chunks assumes."""
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    # Fixed value: the split pattern of the public vocabulary file.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return kinds == ["NFC", "Replace", "Lowercase"] and splits == [("Split", pattern), ("ByteLevel", None)]


def _is_by_bytes(spec: dict) -> bool:
    """Whether the tokenizer is byte-level BPE that neither normalizes nor adds a blank in front."""
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec["model"].get("type") == "BPE"


_encoders: dict[int, Encoder] = {}


def encoder(data: str) -> Encoder:
    """The encoder of a JSON file's text, built once per worker."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


_PACKED = [("start", "u4"), ("size", "u4"), ("n", "u4"), ("ids", "u4")]


def _packed(pieces: list[Piece]) -> dict[str, bytes]:
    """Pieces as arrays: places, sizes, numbers of ids and ids."""
    ids = [i for _, _, own in pieces for i in own]
    columns = {"start": [a for a, _, _ in pieces], "size": [b - a for a, b, _ in pieces], "n": [len(own) for _, _, own in pieces], "ids": ids}
    return {c: np.array(columns[c], t).tobytes() for c, t in _PACKED}


def _unpacked(row: dict) -> list[Piece]:
    start, size, n, ids = (np.frombuffer(row[c], t).astype(np.int64).tolist() for c, t in _PACKED)
    out, at = [], 0
    for a, k, m in zip(start, size, n):
        out.append((a, a + k, tuple(ids[at : at + m])))
        at += m
    return out


def joined_parts(t: Encoder, rows: Iterable[dict], leaf: int) -> list[int]:
    """Ids of a text from its parts (text and packed pieces) in order.

    Pieces of all parts but the last are kept as ids. A join that would need text before
    that part, which no boundary settled, encodes the whole text again.
    """
    settled, texts_, left, base = array("I"), [], [], 0
    for row in rows:
        right = _unpacked(row)
        if texts_:
            last, text = texts_[-1], texts_[-1] + row["text"]
            local = lambda pieces: [(a - base, b - base, ids) for a, b, ids in pieces]
            both = t.join(text, local(left), local(right), 0, len(last), len(text), more=len(texts_) > 1)
            if both is None:
                return t.long("".join([*texts_, row["text"], *(r["text"] for r in rows)]), leaf)
            base += len(last)
            cut_ = next((k for k, p in enumerate(both) if p[0] >= len(last)), len(both))
            # What begins before the part belongs to the text already settled, but for the pieces that the next join may still need.
            keep = max(0, cut_ - RUN)
            settled.extend(i for _, _, ids in both[:keep] for i in ids)
            left = [(a + base - len(last), b + base - len(last), ids) for a, b, ids in both[keep:]]
        else:
            left = right
        texts_.append(row["text"])
    return [*settled, *(i for _, _, ids in left for i in ids)]


def encode_documents(docs: DataFrame, vocabulary: str, leaf: int = LEAF, keep_ids: bool = True, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, ids (if kept), ids_sha256 and decoded_sha256 of every whole text.

    ``vocabulary``: path, on the driver, of a tokenizers JSON file. Texts of more than
    ``spread`` characters are encoded in parts, by as many tasks as there are.
    """
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read()
    spec = json.loads(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)  # one vocabulary file
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def results(t: Encoder, ids: list[list[int]]) -> dict:
        named = t.named
        out = {
            "n_tokens": [len(x) for x in ids], "ids_sha256": [sha(" ".join([named[i] for i in x])) for x in ids],
            "decoded_sha256": [sha(t.library.decode(x, skip_special_tokens=False)) for x in ids],  # a batch would spin threads of its own
        }
        return out | ({"ids": ids} if keep_ids else {})

    def per_task():
        t = encoder(shared.value)

        def one(batch: pa.RecordBatch) -> dict:
            many = texts(batch)
            lots = [results(t, t.encode(many[k : k + CALL], leaf)) for k in range(0, len(many), CALL)] or [results(t, [])]
            return {"doc_id": column(batch, "doc_id")} | {c: [x for lot in lots for x in lot[c]] for c in lots[0]}

        return one

    rows = keyed_texts(docs)
    if not (_is_known(spec) or _is_by_bytes(spec)):
        return map_rows(rows, per_task, ddl)
    # Bytes first: they are known, characters have to be counted.
    is_long = F.coalesce((F.octet_length("text") > spread) & (F.length("text") > spread), F.lit(False))
    keys = ["doc_id", "th", "row"]
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / spread).cast("int")))
    parts = rows.where(is_long).withColumns({"th": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    parts = parts.select(*keys, "text", k.alias("k")).select(*keys, "k", F.substring(F.col("text"), F.col("k") * spread + 1, F.lit(spread)).alias("text"))

    def per_part():
        t = encoder(shared.value)

        def one(batch: pa.RecordBatch) -> dict:
            found = [_packed(t.tree(x, n * spread, leaf)) for x, n in zip(texts(batch), column(batch, "k").to_pylist())]
            return {c: column(batch, c) for c in (*keys, "k", "text")} | {c: [x[c] for x in found] for c, _ in _PACKED}

        return one

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(shared.value)
        rows = (dict(zip(b.schema.names, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (doc, _, _), own in groupby(rows, key=lambda r: tuple(r[c] for c in keys)):
            found = results(t, [joined_parts(t, own, leaf)])
            yield pa.RecordBatch.from_pydict({"doc_id": [doc]} | found, schema=schema)

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    encoded = map_rows(parts.repartition(*keys, "k"), per_part, "doc_id long, th long, row long, k int, text string, " + ", ".join(f"{c} binary" for c, _ in _PACKED))
    whole = encoded.repartition(*keys).sortWithinPartitions(*keys, "k").mapInArrow(together, ddl)
    return map_rows(rows.where(~is_long), per_task, ddl).unionByName(whole)
