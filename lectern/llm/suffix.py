"""Exact-substring dedup over byte suffixes, range-partitioned and sorted bucket by bucket.

A byte is removed if it lies in a LENGTH-byte string that also starts in a document with a
smaller doc_id. Every LENGTH-byte suffix head (window) is placed by its leading token: the
ANCHOR bytes inside the window whose hash is least, which equal windows share. Neighbouring
windows mostly share their token too, so one segment of text carries them all.

First the tokens' hashes alone are compared, and each part of the documents learns which of
its tokens stand in other documents too. Only segments of those travel, each once for a lot of
a part's documents however often it stands there, range-partitioned by token with splitters
sampled from tokens. The segments of a token are the suffixes that start with it, with what the windows need to
its left, so a bucket holds a range of suffixes by their leading token; shipping a suffix
for every byte instead would send LENGTH times the input. A bucket sorts its segments by
token and then by multikey quicksort:
first whole segments, so that copies fall into one class with one least doc_id, then, where a
token has several classes, their windows. Equal windows always share a token, and the last
token of each bucket is compared with the first of the next: as the splitters are whole
tokens they differ, so no class goes on across a boundary.

Back to each part goes, for every segment that some of its documents lose bytes by, the least
doc_id that holds each of its windows; the part looks its own segments up and cuts its texts.
So a passage that a third of all documents share travels once a lot, not once a document.

Defined cases: a null text is empty; a document shorter than LENGTH keeps everything; rows
with a null doc_id neither lose bytes nor take them from others, and are dealt by their
text; very long texts are cut into overlapping pieces of PIECE bytes; other columns are not
looked at, whatever their names; rows that share a doc_id
are not smaller than each other and are told apart by their text; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import bound_batches
from lectern.llm.hashing import mix, stretches
from lectern.runtime import cut, ship

LENGTH, ANCHOR = 50, 20
#: Bytes of text whose windows are placed at once, of segments in one lot, and segments whose windows are unrolled at once.
PIECE, LOT, UNROLL = 1 << 21, 1 << 23, 1 << 15
#: Documents, and tokens of each, that the splitters are sampled from.
SAMPLE_DOCS, SAMPLE_TOKENS = 4000, 64

_LOW = np.uint64((1 << 28) - 1)


def _words(buf: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes at every place of a buffer, as integers; the last 7 places are left out."""
    return np.ndarray((max(0, len(buf) - 7),), f"{order}u8", buf, strides=(1,))


def _token_words() -> list[int]:
    """Offsets of 8-byte words that cover a token."""
    return [*range(0, ANCHOR - 8, 8), ANCHOR - 8]


def runs(buf: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, token place, token hash) of maximal runs of valid windows with one token.

    valid: whether the window at each place counts; the token of a window is the ANCHOR
    bytes with the least hash in it, the leftmost of equals.
    """
    span = length - ANCHOR + 1
    n = len(buf)
    if n < length or not valid.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    v = _words(np.concatenate([buf, np.zeros(ANCHOR + 8, np.uint8)]), "<")
    h = np.zeros(n, np.uint64)
    for at in _token_words():
        h ^= v[at : n + at]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    least = h & ~_LOW
    least |= np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[span - width :][: n - span + 1])
    place = (least & _LOW).astype(np.int64)[: n - length + 1]
    valid = valid[: n - length + 1]
    same = np.zeros(len(valid), bool)
    same[1:] = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
    first = np.flatnonzero(valid & ~same)
    ends = valid & ~np.append(same[1:], False)
    return first, np.flatnonzero(ends) - first + 1, place[first], h[place[first]]


def tokens_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """ANCHOR-byte tokens at some places, in an order of their own that is the same everywhere."""
    return np.ascontiguousarray(buf[places[:, None] + np.arange(ANCHOR)]).view(f"S{ANCHOR}").ravel()


def multikey_sort(first: np.ndarray, symbol: Callable[[np.ndarray, np.ndarray], np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): multikey quicksort of elements 0..n-1; equal ones are neighbours, starts begin each class.

    Elements are sorted by ``first``, then symbol by symbol: in every round each open group
    splits by its middle element's symbol into less, equal and greater; only equal moves on
    to the next symbol. symbol(elements, levels) gives 64-bit symbols; depth their numbers.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    begins = np.ones(n, bool)
    begins[1:] = first[order][1:] != first[order][:-1]
    at, item, level, edge = np.arange(n), order.copy(), np.zeros(n, np.int64), begins.copy()
    while len(at):
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(at)))
        open_ = np.repeat(size > 1, size) & (level < depth[item])
        if not open_.all():
            at, item, level, edge = at[open_], item[open_], level[open_], edge[open_]
            if not len(at):
                break
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(at)))
        s = symbol(item, level)
        pivot = np.repeat(s[start + size // 2], size)
        side = (s > pivot).astype(np.int64) - (s < pivot)
        label = np.repeat(np.arange(len(start)) * 3 + 1, size) + side
        turn = np.argsort(label, kind="stable")
        item, level, label = item[turn], (level + (side == 0))[turn], label[turn]
        edge = np.ones(len(at), bool)
        edge[1:] = label[1:] != label[:-1]
        order[at], begins[at] = item, edge
    return order, np.flatnonzero(begins)


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... count[k] of them, for every k."""
    total = int(count.sum())
    return np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total) if total else np.zeros(0, np.int64)


def identity(buf: np.ndarray, first: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Hashes that name segments: their bytes, and where their token is."""
    return mix(stretches(buf, first, first + size) + offset.astype(np.uint64))


def window_holders(buf: np.ndarray, n_windows: np.ndarray, offset: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, count, holders): the least document with each window of segments that some owner loses bytes by.

    buf: the segments one after another, each of n_windows + length - 1 bytes with its token
    at ``offset``; low and high: the least and greatest of its owners. count is 1, with one
    holder, where all windows have the same one, else the number of windows.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(low):
        return none
    size = n_windows + length - 1
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    words = _words(buf, ">")
    # Tokens, and those that stand in more than one document.
    symbols = [words[base + offset + at].astype(np.uint64) for at in _token_words()]
    order = np.lexsort(symbols[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in symbols:
        new[1:] |= x[order][1:] != x[order][:-1]
    del symbols
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(order)))
    several = np.minimum.reduceat(low[order], start) != np.maximum.reduceat(high[order], start)
    token = np.repeat(np.arange(len(start)), count)[np.repeat(several, count)]
    kept = order[np.repeat(several, count)]
    if not len(kept):
        return none
    base, size, n_windows, offset, low, high = base[kept], size[kept], n_windows[kept], offset[kept], low[kept], high[kept]
    # Classes of equal segments.
    form = offset * 256 + n_windows

    def of_segment(k: np.ndarray, level: np.ndarray) -> np.ndarray:
        return np.where(level == 0, form[k].astype(np.uint64), words[base[k] + np.minimum(8 * np.maximum(level - 1, 0), size[k] - 8)].astype(np.uint64))

    order, start = multikey_sort(token, of_segment, 1 + -(-size // 8))
    count = np.diff(np.append(start, len(order)))
    lead, least = order[start], np.minimum.reduceat(low[order], start)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.repeat(np.arange(len(start)), count)
    # Windows of classes whose token has others; alone, a class's least doc holds all its windows.
    shared = np.bincount(token[lead], minlength=token[-1] + 1)[token[lead]] > 1
    first = np.concatenate(([0], np.cumsum(n_windows[lead])[:-1]))
    holder = np.repeat(least, n_windows[lead])
    some = np.flatnonzero(shared)
    if len(some):
        k = np.repeat(some, n_windows[lead[some]])
        j = _expand(np.zeros(len(some), np.int64), n_windows[lead[some]])
        seg = lead[k]
        where = base[seg] + j

        def of_window(w: np.ndarray, level: np.ndarray) -> np.ndarray:
            return words[where[w] + np.minimum(8 * level, length - 8)].astype(np.uint64)

        order, start = multikey_sort(token[seg] * 64 + (offset[seg] - j), of_window, np.full(len(where), -(-length // 8)))
        lowest = np.minimum.reduceat(least[k][order], start)
        holder[(first[k] + j)[order]] = np.repeat(lowest, np.diff(np.append(start, len(order))))
    # Back to every segment that has an owner above a holder.
    alone = ~shared[kind]
    whole = np.flatnonzero(alone & (high > least[kind]))
    found = [(kept[whole], np.ones(len(whole), np.int64), least[kind[whole]])]
    rest = np.flatnonzero(~alone)
    for at in range(0, len(rest), UNROLL):
        k = rest[at : at + UNROLL]
        own = holder[_expand(first[kind[k]], n_windows[k])]
        begin = np.concatenate(([0], np.cumsum(n_windows[k])[:-1]))
        least_own, most_own = np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin)
        wanted, same = high[k] > least_own, least_own == most_own
        count = np.where(same, 1, n_windows[k])[wanted]
        found.append((kept[k[wanted]], count, own[_expand(begin[wanted], count)]))
    return tuple(np.concatenate([x[i] for x in found]) for i in range(3))


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (doc ^ (doc >> np.int64(17))) % parts


def _part_column(parts: int) -> F.Column:
    doc = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)), F.lit(parts)).cast("int")


def _rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


class _Blobs:
    """Arrays of fixed types, packed together and compressed."""

    def __init__(self, *types: str):
        self.types = types

    def pack(self, *arrays: np.ndarray) -> bytes:
        parts = [np.ascontiguousarray(a, t).tobytes() for a, t in zip(arrays, self.types)]
        return zstandard.ZstdCompressor(level=1).compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))

    def unpack(self, blob: bytes) -> list[np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        sizes = np.frombuffer(raw, np.int64, len(self.types))
        out, at = [], 8 * len(self.types)
        for size, t in zip(sizes.tolist(), self.types):
            out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
            at += size
        return out


#: Windows, token offset, least and greatest owner, bytes; the part.
_SEGMENTS = _Blobs("u1", "u1", "i8", "i8", "u1", "u4")
#: Parts, token hashes inside a bucket, whether in several documents of the part.
_TOKENS = _Blobs("u4", "u4", "u1")
#: Keys of tokens: bucket and hash.
_KEYS = _Blobs("u8")
#: Names of segments, numbers of holders, holders.
_HOLDERS = _Blobs("u8", "u1", "i8")
#: The bucket, its first and last token.
_BORDERS, BORDER = _Blobs("i8", "u1"), -1
#: doc_ids, whether null, sizes, bytes.
_TEXTS = _Blobs("i8", "u1", "i8", "u1")


#: doc_id, number of the row, bytes.
Doc = tuple[int, int, bytes]


def _pieces(docs: Iterator[Doc], length: int) -> Iterator[tuple]:
    """(buf, valid, doc, row, start in doc, start in buf) with texts joined, and long ones cut, to about PIECE bytes.

    A long text's parts overlap by length - 1 bytes, so each window is whole in one part.
    """
    held, total = [], 0

    def shut() -> tuple:
        sizes = np.array([len(h[3]) for h in held])
        buf = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        ends = np.cumsum(sizes)
        valid = np.zeros(len(buf) + 1, np.int8)
        long = sizes >= length
        np.add.at(valid, (ends - sizes)[long], 1)
        np.add.at(valid, (ends - length + 1)[long], -1)
        return (buf, np.cumsum(valid[:-1], dtype=np.int8) > 0, *(np.array([h[k] for h in held], np.int64) for k in range(3)), ends - sizes)

    for doc, row, raw in docs:
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            part = raw[at : at + PIECE + length - 1]
            held.append((doc, row, at, part))
            total += len(part)
            if total >= PIECE:
                yield shut()
                held, total = [], 0
    if held:
        yield shut()


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[Doc]:
    """Documents with an id, from (doc_id, text)."""
    for b in batches:
        for doc, text in zip(*(b.column(k).to_pylist() for k in range(2))):
            if doc is not None:
                yield doc, 0, text.encode("utf-8", "surrogatepass")


def splitters(rows: DataFrame, buckets: int, length: int) -> np.ndarray:
    """At most buckets - 1 tokens that cut a sample of tokens evenly."""
    ids = cut(rows.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, valid, _, _, _, begin in _pieces(_docs(batches), length):
            _, _, place, _ = runs(buf, valid, length)
            step = max(1, len(place) // (SAMPLE_TOKENS * len(begin)))
            yield pa.RecordBatch.from_arrays([pa.array([tokens_at(buf, place[::step]).tobytes()], pa.binary())], ["tokens"])

    found = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(run, "tokens binary").collect()
    tokens = np.sort(np.frombuffer(b"".join(bytes(r.tokens) for r in found), f"S{ANCHOR}"))
    return np.unique(tokens[(np.arange(1, buckets) * len(tokens)) // buckets]) if len(tokens) else tokens


def _key(token_hash: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, hash inside the bucket) of tokens."""
    h = (token_hash ^ (token_hash >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(buckets)).astype(np.int64), h >> np.uint64(32)


def _split(values: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places) from an order that sorts the values."""
    names, cuts = np.unique(values[order], return_index=True)
    for name, lo, hi in zip(names.tolist(), cuts, [*cuts[1:], len(order)]):
        yield name, order[lo:hi]


def _table(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([y for _, y in rows], pa.binary())], [name, "blob"])


def shared_tokens(rows: DataFrame, parts: int, buckets: int, length: int) -> DataFrame:
    """(part, blob) of the keys of tokens in a part's documents that stand in other documents too.

    Keys are hashes, so a few tokens may be named wrongly; none is left out.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, valid, doc, _, _, begin in _pieces(_docs(batches), length):
            first, _, _, h = runs(buf, valid, length)
            if not len(first):
                continue
            bucket, inner = _key(h, buckets)
            owner = np.searchsorted(begin, first, side="right") - 1
            part = part_of(doc, parts)[owner]
            order = np.lexsort((owner, inner, part, bucket))
            bucket, inner, part, owner = bucket[order], inner[order], part[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (inner[1:] != inner[:-1])
            start = np.flatnonzero(new)
            several = doc[np.minimum.reduceat(owner, start)] != doc[np.maximum.reduceat(owner, start)]
            bucket, inner, part = bucket[start], inner[start], part[start]
            yield _table([(b, _TOKENS.pack(part[k], inner[k], several[k])) for b, k in _split(bucket, np.arange(len(start)))], "bucket")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _gathered(batches):
            columns = [_TOKENS.unpack(x) for x in blobs]
            part, inner, several = (np.concatenate([c[k] for c in columns]) for k in range(3))
            order = np.argsort(inner, kind="stable")
            part, inner, several = part[order], inner[order], several[order] > 0
            start = np.flatnonzero(np.append(True, inner[1:] != inner[:-1]))
            size = np.diff(np.append(start, len(inner)))
            keep = np.repeat((size > 1) | np.logical_or.reduceat(several, start), size)
            part, keys = part[keep].astype(np.int64), inner[keep].astype(np.uint64) | np.uint64(bucket << 32)
            if len(part):
                yield _table([(p, _KEYS.pack(keys[k])) for p, k in _split(part, np.argsort(part, kind="stable"))], "part")

    return rows.mapInArrow(hashes, "bucket int, blob binary").repartition(buckets, "bucket").mapInArrow(compare, "part int, blob binary")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(number, blobs) of every bucket of a task."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(number, []).append(blob)
    for number in list(held):
        yield number, held.pop(number)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], Iterator[bytes]]]:
    """(part, blobs of kind 0, iterator of blobs of kind 1) of every part, from rows sorted by part and kind."""
    rows = ((p, k, x) for b in batches for p, k, x in zip(*(b.column(i).to_pylist() for i in range(3))))
    for part, own in groupby(rows, key=lambda r: r[0]):
        first, texts = [], iter(())
        for row in own:
            if row[1]:
                texts = chain([row[2]], (r[2] for r in own))
                break
            first.append(row[2])
        yield part, first, texts


def _together(small: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    both = small.select("part", F.lit(0).alias("kind"), "blob").unionByName(texts.select("part", F.lit(1).alias("kind"), "blob"))
    return both.repartition(parts, "part").sortWithinPartitions("part", "kind")


def placed_segments(keys: DataFrame, texts: DataFrame, split: np.ndarray, parts: int, buckets: int, length: int) -> DataFrame:
    """(bucket, blob) of the segments whose token is among their part's keys."""
    shared = keys.sparkSession.sparkContext.broadcast(split)  # one token a bucket

    def unpacked(blobs: Iterator[bytes]) -> Iterator[Doc]:
        for doc, null, raw in (d for x in blobs for d in _unpacked(x)):
            if not null:
                yield doc, 0, raw

    def lot(part: int, held: list[tuple]) -> pa.RecordBatch:
        bucket, name, count, offset, doc, text = (np.concatenate([h[k] for h in held]) for k in range(6))
        size = count + length - 1
        base = np.concatenate(([0], np.cumsum(size)[:-1]))
        order = np.lexsort((name, bucket))
        start = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
        one, low, high = order[start], np.minimum.reduceat(doc[order], start), np.maximum.reduceat(doc[order], start)
        rows = []
        for b, k in _split(bucket[one], np.arange(len(one))):
            own = one[k]
            rows.append((b, _SEGMENTS.pack(count[own], offset[own], low[k], high[k], text[_expand(base[own], size[own])], np.array([part]))))
        return _table(rows, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, key_blobs, blobs in _by_part(batches):
            held, total = [], 0
            known = np.sort(np.concatenate([_KEYS.unpack(x)[0] for x in key_blobs])) if key_blobs else np.zeros(0, np.uint64)
            for buf, valid, doc, _, _, begin in _pieces(unpacked(blobs), length):
                if not len(known):
                    continue
                first, count, place, h = runs(buf, valid, length)
                number, inner = _key(h, buckets)
                key = inner | (number.astype(np.uint64) << np.uint64(32))
                k = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
                if not len(k):
                    continue
                first, count, place = first[k], count[k], place[k]
                owner = np.searchsorted(begin, first, side="right") - 1
                bucket = np.searchsorted(shared.value, tokens_at(buf, place), side="right")
                text = buf[_expand(first, count + length - 1)]
                held.append((bucket, identity(buf, first, count + length - 1, place - first), count, place - first, doc[owner], text))
                total += len(text)
                if total >= LOT:
                    yield lot(part, held)
                    held, total = [], 0
            if held:
                yield lot(part, held)

    return _together(keys, texts, parts).mapInArrow(run, "bucket int, blob binary")


def found_holders(segments: DataFrame, length: int) -> DataFrame:
    """(part, blob) of the holders of segments, for the parts that asked; as part BORDER the first and last token of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _gathered(batches):
            columns = [_SEGMENTS.unpack(x) for x in blobs]
            part = np.repeat([int(c[5][0]) for c in columns], [len(c[0]) for c in columns])
            n, offset = (np.concatenate([c[k] for c in columns]).astype(np.int64) for k in (0, 1))
            low, high, buf = (np.concatenate([c[k] for c in columns]) for k in (2, 3, 4))
            del columns
            tokens = np.sort(tokens_at(buf, np.concatenate(([0], np.cumsum(n + length - 1)[:-1])) + offset))
            yield _table([(BORDER, _BORDERS.pack(np.array([bucket]), np.frombuffer(tokens[0].ljust(ANCHOR, b"\0") + tokens[-1].ljust(ANCHOR, b"\0"), np.uint8)))], "part")
            seg, count, holder = window_holders(buf, n, offset, low, high, length)
            if not len(seg):
                continue
            size = n + length - 1
            base = np.concatenate(([0], np.cumsum(size)[:-1]))[seg]
            name = identity(buf, base, size[seg], offset[seg])
            begin = np.concatenate(([0], np.cumsum(count)[:-1]))
            order = np.lexsort((name, part[seg]))
            yield _table([(p, _HOLDERS.pack(name[k], count[k], holder[_expand(begin[k], count[k])])) for p, k in _split(part[seg], order)], "part")

    return segments.mapInArrow(run, "part int, blob binary")


def compare_borders(blobs: list[bytes]) -> None:
    """Compares the last token of each bucket with the first of the next: equal ones would have equal suffixes on both sides."""
    borders = sorted((int(b[0]), t[:ANCHOR].tobytes(), t[ANCHOR:].tobytes()) for b, t in map(_BORDERS.unpack, blobs))
    for (_, _, last), (bucket, first, _) in zip(borders, borders[1:]):
        if last >= first:
            raise RuntimeError(f"bucket {bucket} begins with a token that an earlier one holds")


def packed_texts(rows: DataFrame, parts: int) -> DataFrame:
    """(part, blob) of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list] = {}
            for part, doc, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                by.setdefault(part, []).append((doc or 0, doc is None, text.encode("utf-8", "surrogatepass")))
            blobs = [
                _TEXTS.pack(*(np.array([d[k] for d in docs]) for k in range(2)), np.array([len(d[2]) for d in docs]), np.frombuffer(b"".join(d[2] for d in docs), np.uint8))
                for docs in by.values()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return rows.select(_part_column(parts).alias("part"), "doc_id", "text").mapInArrow(run, "part int, blob binary")


def deduplicated(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, kept (bytes) of every row."""
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    rows = _rows_of(docs)
    texts = packed_texts(rows, parts)
    split = splitters(rows, buckets, length)
    keys = cut(shared_tokens(rows, parts, buckets, length))
    segments = placed_segments(keys, texts, split, parts, buckets, length).repartition(buckets, "bucket")
    holders = cut(found_holders(segments, length))
    compare_borders([bytes(r.blob) for r in holders.where(F.col("part") == BORDER).select("blob").collect()])  # one row a bucket
    holders = holders.where(F.col("part") != BORDER)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] + [("kept", pa.binary())] * keep_bytes
    schema = pa.schema(fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs, texts in _by_part(batches):
            known = _index([_HOLDERS.unpack(x) for x in blobs])
            for docs in _lots(texts):
                spans = _spans_of(docs, known, length)
                yield pa.RecordBatch.from_pylist([_cut_text(d, x, keep_bytes) for d, x in zip(docs, spans)], schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>" + ", kept binary" * keep_bytes
    return _together(holders, texts, parts).mapInArrow(apply, ddl)


def _index(holders: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, first holders, numbers, holders), by name."""
    name, count, holder = (np.concatenate([h[k] for h in holders]) if holders else np.zeros(0, t) for k, t in enumerate(_HOLDERS.types))
    count = count.astype(np.int64)
    order = np.argsort(name, kind="stable")
    return name[order], np.concatenate(([0], np.cumsum(count)))[:-1][order], count[order], holder


def _unpacked(blob: bytes) -> Iterator[tuple[int, bool, bytes]]:
    """(doc_id, whether null, bytes) of packed documents."""
    docs, nulls, sizes, data = _TEXTS.unpack(blob)
    data, at = data.tobytes(), 0
    for doc, null, size in zip(docs.tolist(), nulls.tolist(), sizes.tolist()):
        yield doc, bool(null), data[at : at + size]
        at += size


def _lots(blobs: Iterator[bytes]) -> Iterator[list[tuple[int, bool, bytes]]]:
    """Documents in lists of about PIECE bytes."""
    held, total = [], 0
    for doc in (d for x in blobs for d in _unpacked(x)):
        held.append(doc)
        total += len(doc[2])
        if total >= PIECE:
            yield held
            held, total = [], 0
    if held:
        yield held


def _spans_of(docs: list[tuple[int, bool, bytes]], known: tuple[np.ndarray, ...], length: int) -> list[list[tuple[int, int]]]:
    """The byte ranges that each document loses, merged."""
    out: list[list[tuple[int, int]]] = [[] for _ in docs]
    names, begins, numbers, holders = known
    if not len(names):
        return out
    found = []
    numbered = ((d, k, raw) for k, (d, null, raw) in enumerate(docs) if not null)
    for buf, valid, doc, row, at, begin in _pieces(numbered, length):
        first, count, place, _ = runs(buf, valid, length)
        name = identity(buf, first, count + length - 1, place - first)
        where = np.minimum(np.searchsorted(names, name), len(names) - 1)
        k = np.flatnonzero(names[where] == name)
        if not len(k):
            continue
        first, count, where = first[k], count[k], where[k]
        owner = np.searchsorted(begin, first, side="right") - 1
        seg = np.repeat(np.arange(len(k)), count)
        j = _expand(np.zeros(len(k), np.int64), count)
        gone = doc[owner][seg] > holders[begins[where][seg] + np.where(numbers[where][seg] == 1, 0, j)]
        start = (at[owner] + first - begin[owner])[seg[gone]] + j[gone]
        found.append((row[owner][seg[gone]], start))
    if found:
        rows, starts = (np.concatenate([f[k] for f in found]) for k in range(2))
        order = np.lexsort((starts, rows))
        rows, starts = rows[order], starts[order]
        fresh = np.append(True, (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length))[: len(rows)]
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], len(rows)) - 1
        for r, lo, hi in zip(rows[at].tolist(), starts[at].tolist(), starts[last].tolist()):
            out[r].append((lo, hi + length))
    return out


def _cut_text(doc: tuple[int, bool, bytes], spans: list[tuple[int, int]], keep_bytes: bool) -> dict:
    name, null, raw = doc
    kept, done = [], 0
    for lo, hi in spans:
        kept.append(raw[done:lo])
        done = hi
    rest = b"".join([*kept, raw[done:]])
    out = {"doc_id": None if null else name, "n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(spans), "kept_sha256": hashlib.sha256(rest).hexdigest()}
    return out | {"spans": [{"start": lo, "end": hi} for lo, hi in spans]} | ({"kept": rest} if keep_bytes else {})
