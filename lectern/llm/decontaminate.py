"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The
automaton accepts every word sequence inside an item; streaming a document through it
gives at each word the longest suffix that some item contains, so every occurrence of a
window (13 consecutive item words, or a whole shorter item) shows as a match length.

The benchmark is dealt to blocks of about BLOCK_WORDS words, an automaton each, which tasks
build at the same time and keep in a table; long items are dealt in pieces that overlap by a
window less a word. The driver hands automata on one by one. PASS_BLOCKS, packed, go to the
tasks for one pass over the documents; a task has KEEP unpacked at most. Where there are
more, it gathers GATHER bytes of texts before it takes one automaton after the other, so each
is unpacked once for so much text. A larger benchmark takes more passes, whose hits are
merged, so what is broadcast is bounded.

``filtered`` removes what exceeds a limit: documents whose hits cover one word in COVERAGE
go, and from the others each span of hit words is cut out.

Defined cases: null texts and items have no words, and an item without words has no window;
repeated items and documents each count by their own row; n_items counts distinct item ids,
and an item with a null id hits words without being counted or listed; very long texts are
scanned whole, in linear time; other columns are not looked at; empty tables give empty or
untouched results.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import column, keyed_texts, map_rows, sha, texts
from lectern.runtime import discard, written

WINDOW = 13
#: Words of items in one automaton, automata that a task has unpacked at once, and that go out for one pass.
BLOCK_WORDS, KEEP, PASS_BLOCKS = 200_000, 4, 32
#: Bytes of texts that meet an automaton each time it is unpacked, where there are more than KEEP.
GATHER = 1 << 25
#: A document is contaminated if hits cover at least one word in so many.
COVERAGE = 20

_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids of many items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = sorted({name for name, words in items if words and name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        own: dict[int, set] = {}  # numbers of the items that have a prefix ending in a state
        tails = []
        for name, words in items:
            last, k = 0, number.get(name, -1)
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                own.setdefault(last, set()).add(k)
            if 0 < len(words) < window:
                tails.append((len(words), k, [self.vocab[w] for w in words]))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: Per state: its ancestor or itself whose strings' shortest has window words at most, and their longest at least.
        self.top = [0] * len(self.next)
        self.ends: dict[int, set] = {}
        for v in order:
            if self.length[v] >= window:
                above = self.link[v]
                self.top[v] = v if self.length[above] < window else self.top[above]
                self.ends.setdefault(self.top[v], set()).update(own.get(v, ()))
        #: Short items by the state of their words; per state the nearest ancestor, or itself, that has any.
        self.short: dict[int, list] = {}
        for n, item, ids in tails:
            v = 0
            for c in ids:
                v = self.next[v][c]
            self.short.setdefault(v, []).append((n, item))
        self.near = [0] * len(self.next)
        for v in order:
            self.near[v] = v if v in self.short else self.near[self.link[v]]
        self.least = min([window] + [n for n, _, _ in tails])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        me = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = me
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[me] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return me

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        me = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = me
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = me
            p = link[p]
        return me

    def scan(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark in ``hit`` (n + 1 differences) the words of every occurring window; add item names."""
        n = len(words)
        if n < self.least:
            return
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        out = np.flatnonzero(np.concatenate(([-1], ids, [-1])) < 0)
        gaps = np.flatnonzero(np.diff(out) > self.least)
        if not len(gaps):
            return
        nxt, link, length, near, window = self.next, self.link, self.length, self.near, self.window
        seen: set[int] = set()
        for lo, hi in zip(out[gaps].tolist(), (out[gaps + 1] - 1).tolist()):
            v = size = 0
            for at, c in enumerate(ids[lo:hi].tolist(), lo):
                step = nxt[v].get(c)
                while step is None and v:
                    v = link[v]
                    size = length[v]
                    step = nxt[v].get(c)
                if step is None:
                    v = size = 0
                    continue
                v, size = step, size + 1
                if size >= window:
                    hit[at + 1 - window] += 1
                    hit[at + 1] -= 1
                    seen.add(self.top[v])
                u = near[v]
                while u:
                    for m, item in self.short[u]:
                        if m <= size:
                            hit[at + 1 - m] += 1
                            hit[at + 1] -= 1
                            if item >= 0:
                                items.add(self.names[item])
                    u = near[link[u]]
        items.update(self.names[k] for u in seen for k in self.ends[u] if k >= 0)


def _pieces(words: list[bytes], window: int, block_words: int) -> Iterator[list[bytes]]:
    """Pieces that hold the same windows, none longer than an eighth of a block unless a window is."""
    most = max(block_words // 8, window)
    if len(words) <= most:
        yield words
    else:
        for k in range(0, len(words) - window + 1, most - window + 1):
            yield words[k : k + most]


def _automata(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """(block, data): packed automata of a benchmark's blocks, built by tasks and written to the shared folder."""

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            item, rows = column(batch, "item_id").to_pylist(), [words_of(t) for t in texts(batch)]
            found = [(i, p) for i, w in zip(item, rows) if w for p in _pieces(w, window, block_words)]
            return {"item": [i for i, _ in found], "n": [len(p) for _, p in found], "words": [b" ".join(p) for _, p in found]}

        return one

    def build(table: pa.Table) -> pa.Table:
        items = sorted(zip(table["item"].to_pylist(), table["words"].to_pylist()), key=lambda x: (x[0] or "", x[1]))
        made = SuffixAutomaton([(item, words.split()) for item, words in items], window)
        return pa.table({"block": table["block"][:1], "data": pa.array([packed(made)], pa.binary())})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = written(map_rows(items, per_task, "item string, n long, words binary").distinct())
    blocks = ceil((pieces.agg(F.sum("n")).first()[0] or 0) / block_words)
    # A number of parts that is asked for stays, so that each block is a task's.
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1))).cast("int")).repartitionByRange(max(blocks, 1), "block")
    made = written(dealt.groupBy("block").applyInArrow(build, "block int, data binary"))
    discard(pieces)
    return made


def packed(automaton: SuffixAutomaton) -> bytes:
    return zlib.compress(pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL), 1)


@lru_cache(KEEP)
def unpacked(data: bytes) -> SuffixAutomaton:
    """An automaton; a worker has the last KEEP, also for the tasks that come after."""
    return pickle.loads(zlib.decompress(data))


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> Iterator[list]:
    """Packed automata, sent to the tasks, of one pass over the documents after the other; one empty pass without items."""
    sc = docs.sparkSession.sparkContext
    made = _automata(benchmark, window, block_words)
    sent: list = []
    some = False
    for row in made.toLocalIterator():
        if len(sent) == PASS_BLOCKS:
            yield sent
            sent = []
        sent.append(sc.broadcast(bytes(row.data)))  # BLOCK_WORDS words
        some = True
    discard(made)
    if sent or not some:
        yield sent


def gathered_bytes(automata: list) -> int:
    """Bytes of texts that a task gathers before it takes one automaton after the other; 0 if it keeps all unpacked."""
    return GATHER if len(automata) > KEEP else 0


class _Held:
    """The automata of a pass, as a task uses them."""

    def __init__(self, automata: list):
        self.automata = automata
        self.gather = gathered_bytes(automata)

    def hits(self, found: list[str]) -> tuple[list[np.ndarray], list[set]]:
        """Per text: whether each word is hit, and the items; each automaton is unpacked once at most."""
        few = [words_of(t) for t in found] if not self.gather else None
        hits = [np.zeros(len(w) + 1, np.int64) for w in few or map(words_of, found)]
        items: list[set] = [set() for _ in found]
        for sent in self.automata:
            scan = unpacked(sent.value).scan
            for w, h, i in zip(few or map(words_of, found), hits, items):
                scan(w, h, i)
        return [np.cumsum(h[:-1]) > 0 for h in hits], items


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of hit words."""
    if not hit.any():
        return []
    on = np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))
    return list(zip(np.flatnonzero(on == 1).tolist(), np.flatnonzero(on == -1).tolist()))


def is_contaminated(n_hit: int, n_words: int, coverage: int = COVERAGE) -> bool:
    return n_hit > 0 and coverage * n_hit >= n_words


_SPANS = "array<struct<start: long, end: long>>"


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, list]:
    """(docs, automata) of a benchmark of one pass; else docs with earlier (spans and items of all passes), and no automata."""
    passes = _passes(docs, benchmark, window, block_words)
    automata = next(passes)
    second = next(passes, None)
    if second is None:
        return docs, automata
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    parts = []
    for sent in chain([automata, second], passes):

        def per_task(sent=sent):
            held = _Held(sent)

            def one(batch: pa.RecordBatch) -> dict:
                hits, items = held.hits(texts(batch))
                some = [k for k, h in enumerate(hits) if h.any()]
                spans = [[{"start": a, "end": b} for a, b in _ranges(hits[k])] for k in some]
                return {"doc_id": column(batch, "doc_id").take(some), "th": column(batch, "th").take(some), "spans": spans, "items": [sorted(items[k]) for k in some]}

            return one

        parts.append(written(map_rows(keyed, per_task, f"doc_id long, th long, spans {_SPANS}, items array<string>", gathered_bytes(sent))))
        for b in sent:
            b.unpersist()
    found = reduce(DataFrame.unionByName, parts).dropDuplicates(["doc_id", "th", "spans", "items"])
    found = found.groupBy("doc_id", "th").agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).alias("earlier"))
    d, f = docs.withColumn("_th", F.xxhash64(text)).alias("d"), found.alias("f")
    joined = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._th") == F.col("f.th")), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], "f.earlier"), []


def _hits_of(batch: pa.RecordBatch, held: _Held) -> tuple[list[np.ndarray], list[set]]:
    """Hit words and items of a batch's texts, from earlier passes or found now."""
    hits, items = held.hits(texts(batch))
    if "earlier" in batch.schema.names:
        for h, i, e in zip(hits, items, column(batch, "earlier").to_pylist()):
            for span in (e or {}).get("spans", ()):
                h[span["start"] : span["end"]] = True
            i.update((e or {}).get("items", ()))
    return hits, items


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of some spans and what stands between those words."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return "".join([*out, text[done:]])


def filtered(docs: DataFrame, benchmark: DataFrame, ddl: str, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` (columns ``ddl``) that are not contaminated, hit spans cut out of their texts; n_chars follows where there is one."""
    rows, automata = _with_hits(docs, benchmark, window, block_words)
    names = docs.columns

    def per_task():
        held = _Held(automata)

        def one(batch: pa.RecordBatch) -> dict:
            hits, _ = _hits_of(batch, held)
            keep = [not is_contaminated(int(h.sum()), len(h), coverage) for h in hits]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            out = {c: column(kept, c) for c in names}
            spans = [_ranges(h) for h, k in zip(hits, keep) if k]
            if any(spans):
                whole = column(kept, "text").to_pylist()
                out["text"] = [without_spans(t, s) if s else t for t, s in zip(whole, spans)]
                if "n_chars" in names:
                    out["n_chars"] = [len(t) if s else n for t, s, n in zip(out["text"], spans, column(kept, "n_chars").to_pylist())]
            return out

        return one

    return map_rows(rows, per_task, ddl, gathered_bytes(automata))


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans are the [start, end) word ranges that windows cover.
    """
    rows, automata = _with_hits(keyed_texts(docs), benchmark, window, block_words)

    def per_task():
        held = _Held(automata)

        def one(batch: pa.RecordBatch) -> dict:
            hits, items = _hits_of(batch, held)
            spans = [_ranges(h) for h in hits]
            n, n_hit = [len(h) for h in hits], [sum(b - a for a, b in s) for s in spans]
            return {
                "doc_id": column(batch, "doc_id"), "n_words": n, "n_hit": n_hit, "n_items": [len(i) for i in items],
                "items_sha256": [sha(",".join(sorted(i))) for i in items],
                "contaminated": [is_contaminated(h, k, coverage) for h, k in zip(n_hit, n)],
                "spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
            }

        return one

    return map_rows(rows, per_task, f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {_SPANS}", gathered_bytes(automata))
