"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A text's set holds its distinct shingles of four words. Its signature has SYMBOLS b-bit
minima; the first CHUNKS * WIDTH are split into chunks, and each chunk is entered once for
each way to leave ERRORS of its symbols out. By pigeonhole, two signatures that differ in
at most CHUNKS * (ERRORS + 1) - 1 of those symbols share an entry, so every pair under that
distance becomes a candidate. Documents with equal sets are one node throughout.

Inside an entry's group, nodes under that distance, or within FAR differing symbols of all
SYMBOLS, are joined into clusters; so no pair that the join guarantees is left out. Each
cluster's full sets then meet, and links are confirmed by exact overlap counts; components
of the links are the result. Groups and clusters above BLOCK nodes are cut into blocks,
and every pair of blocks is a task of its own, so none is ever gathered whole.

Defined cases: null and empty texts have an empty set and link with nothing; fewer words
than a shingle make one shingle of the whole sequence; repeated rows are one node and all
get its component; a null doc_id takes part, but only known ids name a component; very long
texts enter with their whole sets; other columns are not looked at, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import column, map_rows, texts
from lectern.llm.components import connected_components
from lectern.llm.hashing import PRIME, mix, stretches
from lectern.runtime import cut, ship

SHINGLE = 4
SYMBOLS, CHUNKS, WIDTH, ERRORS = 120, 10, 6, 1
#: The signature distance under which every pair is a candidate, in differing symbols of the indexed ones.
NEAR = CHUNKS * (ERRORS + 1) - 1
#: Differing symbols of all SYMBOLS up to which a pair that shares an entry is a candidate, too.
FAR = 44
#: Nodes in a block.
BLOCK = 1024
#: Places that the rows of one component are dealt to when they get its name.
SALTS = 64
#: Links have 100 * intersection >= LEAST * union.
LEAST = 80

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.concatenate(([False], ~_BLANK[raw], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = turns[::2], turns[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    words = stretches(raw, start, stop)
    k = min(SHINGLE, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(PRIME) + words[j : len(words) - k + 1 + j])
    return np.unique(h)


def signature(x: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of a set."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 1024):
        low = np.minimum(low, (x[k : k + 1024, None] * _A + _B).min(0))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def entries(signatures: np.ndarray) -> np.ndarray:
    """(n, entries) 64-bit keys: for each chunk, one for each way to leave ERRORS symbols out."""
    out = []
    for c in range(CHUNKS):
        chunk = signatures[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for gone in combinations(range(WIDTH), ERRORS):
            key = np.full(len(chunk), c * 1009 + sum(WIDTH**i * g for i, g in enumerate(gone)), np.uint64)
            for k in range(WIDTH):
                if k not in gone:
                    key = mix(key * np.uint64(PRIME) + chunk[:, k] + np.uint64(1))
            out.append(key)
    return np.column_stack(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node (digest of the set), sig and rid of every row."""

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t) for t in texts(batch)]
            return {
                "doc_id": column(batch, "doc_id"), "th": column(batch, "th"), "n_shingles": [len(x) for x in sets],
                "node": [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets],
                "sig": [signature(x).tobytes() if len(x) else None for x in sets],
            }

        return one

    rows = map_rows(_rows_of(docs), per_task, "doc_id long, th long, n_shingles long, node binary, sig binary")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def _rows_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def shared_entries(nodes: DataFrame) -> DataFrame:
    """(gid, rid, size) of nodes that share an entry; gid names a group of nodes, whatever entry brought it."""
    buckets = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack():
        def one(batch: pa.RecordBatch) -> dict:
            signatures = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = entries(signatures)
            rids = np.repeat(column(batch, "rid").to_numpy(), keys.shape[1])
            keys = keys.ravel()
            bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[b] : cuts[b + 1]] for b in some]
            return {"bucket": some, "keys": [keys[p].tobytes() for p in parts], "rids": [rids[p].tobytes() for p in parts]}

        return one

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, keys, rids in zip(*(b.column(k).to_pylist() for k in range(3))):
                held.setdefault(bucket, []).append((keys, rids))
        for parts in held.values():
            keys = np.frombuffer(b"".join(k for k, _ in parts), np.uint64)
            rids = np.frombuffer(b"".join(r for _, r in parts), np.int64)
            order = np.lexsort((rids, keys))
            keys, rids = keys[order], rids[order]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(start, len(keys)))
            sums = np.add.reduceat(mix(rids.astype(np.uint64)), start)
            gid = mix(sums + size.astype(np.uint64))
            many = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(gid, size)[many].view(np.int64)), pa.array(rids[many]), pa.array(np.repeat(size, size)[many])], ["gid", "rid", "size"]
            )

    packed = map_rows(nodes.select("rid", "sig"), pack, "bucket int, keys binary, rids binary")
    return packed.repartition(buckets, "bucket").mapInArrow(groups, "gid long, rid long, size long").dropDuplicates(["gid", "rid"])


def by_blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with block, low and high: groups above BLOCK rows are cut into blocks, each pair of blocks once."""
    parts = F.ceil(F.col(size) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rid"), parts).cast("int")
    other = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return other.select(*rows.columns, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of consecutive rows with equal first ``keys`` columns."""
    now, held = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if held is None or row[:keys] != now:
                if held is not None:
                    yield now, held
                now, held = row[:keys], [[] for _ in columns[keys:]]
            for h, x in zip(held, row[keys:]):
                h.append(x)
    if held is not None:
        yield now, held


class Union:
    """Union-find over 0..n-1 whose root is the least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def near_pairs(signatures: np.ndarray) -> Union:
    """Joins all rows within NEAR differing indexed symbols or FAR of all, leaving out pairs that are joined already."""
    n = len(signatures)
    union = Union(n)
    for i in range(n):
        roots = union.roots()
        rest = np.flatnonzero(roots[i:] != roots[i]) + i
        if not len(rest):
            continue
        differ = signatures[rest] != signatures[i]
        near = (differ[:, : CHUNKS * WIDTH].sum(1) <= NEAR) | (differ.sum(1) <= FAR)
        for root in np.unique(roots[rest[near]]):
            union.join(i, int(root))
    return union


def candidate_edges(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join, inside each shared group, nodes within FAR differing symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (rid, sig) in grouped(batches, 3):
            roots = near_pairs(np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SYMBOLS)).roots()
            own = np.flatnonzero(roots != np.arange(len(roots)))
            if len(own):
                rid = np.array(rid)
                yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(rid[roots[own]])], ["a", "b"])

    rows = by_blocks(shared, "gid", "size").join(nodes.select("rid", "sig"), "rid")
    return rows.select("gid", "low", "high", "rid", "sig").repartition("gid", "low", "high").sortWithinPartitions("gid", "low", "high", "rid").mapInArrow(run, "a long, b long")


def exact_links(sets: list[np.ndarray], least: int = LEAST) -> Union:
    """Joins all sets with 100 * intersection >= least * union, by overlap counts over posting lists."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(token))))
    first = np.concatenate(([0], np.cumsum(sizes)))
    union = Union(n)
    for i in range(n - 1):
        mine = token[first[i] : first[i + 1]]
        lo, hi = begin[mine], begin[mine + 1]
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        common = np.bincount(posting[at], minlength=n)
        linked = np.flatnonzero(100 * common[i + 1 :] >= least * (sizes[i] + sizes[i + 1 :] - common[i + 1 :])) + i + 1
        for j in linked.tolist():
            union.join(i, j)
    return union


def confirmed_edges(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes whose full sets are linked, from clusters (node, root)."""
    wanted = clusters.join(nodes.select(F.col("rid").alias("node"), "doc_id", "th"), "node")
    size = wanted.groupBy("root").agg(F.count("*").alias("size"))
    wanted = by_blocks(wanted.join(size, "root").select("root", F.col("node").alias("rid"), "size", "doc_id", "th"), "root", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (rid, sets) in grouped(batches, 3):
            roots = exact_links([np.frombuffer(x, np.uint64) for x in sets]).roots()
            own = np.flatnonzero(roots != np.arange(len(roots)))
            if len(own):
                rid = np.array(rid)
                yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(rid[roots[own]])], ["a", "b"])

    def per_task():
        def one(batch: pa.RecordBatch) -> dict:
            return {"rid": column(batch, "rid"), "set": [shingles(t).tobytes() for t in texts(batch)]}

        return one

    ids = wanted.select("rid", "doc_id", "th").distinct()
    found = _rows_of(docs).alias("d").join(ids.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th")))
    sets = map_rows(found.select("rid", "text"), per_task, "rid long, set binary").dropDuplicates(["rid"])
    rows = wanted.select("root", "low", "high", "rid").join(sets, "rid").select("root", "low", "high", "rid", "set")
    return rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "rid").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id (least doc_id that links reach) and kept of every row."""
    ship(docs.sparkSession)
    prints = cut(fingerprints(docs))
    one = cut(prints.where("node is not null").groupBy("node").agg(F.min("rid").alias("rep")))
    nodes = cut(prints.join(one.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "doc_id", "th", "sig"))
    edges = candidate_edges(cut(shared_entries(nodes)), nodes)
    clusters = cut(connected_components(edges))
    roots = connected_components(confirmed_edges(docs, nodes, clusters)).select(F.col("node").alias("rep"), "root")
    # Node by node first, so that rows meet their class in one join, whose skew Spark can split.
    named = cut(one.join(roots, "rep", "left").select("node", F.coalesce("root", "rep").alias("class")))
    rows = prints.select("doc_id", "th", "n_shingles", "node", "rid")
    classes = rows.where("node is not null").join(named, "node").select("doc_id", "th", "n_shingles", "class")
    classes = cut(classes.unionByName(rows.where("node is null").select("doc_id", "th", "n_shingles", F.col("rid").alias("class"))))
    # Only classes of several rows need a join, and each of them meets its rows in SALTS places.
    least = classes.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("class", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = classes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    out = salted.join(least, ["class", "salt"], "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
