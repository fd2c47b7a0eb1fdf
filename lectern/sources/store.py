"""The chunk table as a log of key-range files: small upserts write what is new, reads merge, compaction rewrites what was hit.

A version is one manifest, put under its number in one rename that fails if the number is
taken, so a writer that dies leaves the version before it, and one that comes second starts
from the version that came first. A manifest lists base files, sorted by key and disjoint,
each with its least and greatest key, rows, bytes and the table of its Bloom filter; deltas,
the new rows of one upsert each, with the base files whose Bloom filter may hold one of their
keys and those in whose range one falls; and the last batch of each stream, so a batch that is
repeated changes nothing. A read takes base files that no delta touches as they are, others
without the keys of the deltas, and the newest row of each key of the deltas. Compaction
rewrites the files in whose range a delta fell, each within its own range, and keeps the rest.

Ids are hashes of keys, so a row keeps its id without the old table being read. Manifests are
read by the driver, an entry a base file, as Spark lists them too.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators.upsert import last_of_key
from lectern.runtime import ship

#: Rows of a file at most, and of a base file that compaction writes, about.
ROWS = 500_000
#: Bits of a Bloom filter for each key of a file, and bits that a key sets; tasks that share the test of one file's keys.
BITS, HASHES, SHARES = 10, 7, 8
#: Deltas, and their share of the base rows, from which an upsert compacts.
MOST_DELTAS, SHARE = 16, 0.5

_COLUMNS = schemas.CHUNK + ", k string"
_NAMES = [c.split(" ")[0] for c in schemas.CHUNK.split(", ")]


def sort_key() -> Column:
    """One string whose order and equality are those of the key; the numbers have ten digits each, so the paper's name may hold anything."""
    number = lambda c: F.lpad((F.col(c).cast("long") + (1 << 31)).cast("string"), 10, "0")
    return F.concat("paper_id", number("section_index"), number("chunk_index"))


def bloom(hashes: np.ndarray) -> bytes:
    """The filter of a file's key hashes."""
    size = 8 * max(8, -(-BITS * len(hashes) // 8))
    bits = np.zeros(size, bool)
    for at in _places(hashes, size):
        bits[at] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    """Whether any of the keys may be one of the file's."""
    table = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    hit = np.ones(len(hashes), bool)
    for at in _places(hashes, len(table)):
        hit &= table[at]
    return bool(hit.any())


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


class VersionedFolder:
    """A folder that the cluster shares, whose versions are manifests (JSON) that writers put whole under the next number."""

    #: The manifest before the first version.
    EMPTY: dict = {"version": 0}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        folder = self._path(self.path)
        self._fs = folder.getFileSystem(conf)
        self._fs.mkdirs(folder)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.NONE
        ship(spark)

    def _current(self) -> dict:
        """The newest manifest; EMPTY before the first."""
        numbers = [int(n.split("-")[1]) for n, _ in self._listed() if n.startswith("manifest-")]
        if not numbers:
            return dict(self.EMPTY)
        stream = self._fs.open(self._path(f"{self.path}/manifest-{max(numbers)}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Puts a manifest whole under its number; False if another writer was first."""
        part, target = self._path(f"{self.path}/_part-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest-{manifest['version']}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._context.rename(part, target, self._no_overwrite)
            return True
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def _listed(self) -> list[tuple[str, float]]:
        """(name, seconds since it was changed) of what lies in the folder."""
        now = time.time()
        return [(s.getPath().getName(), now - s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(self.path))]

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


class ChunkStore(VersionedFolder):
    """The chunk table below a folder that the cluster shares."""

    EMPTY = {"version": 0, "base": [], "deltas": [], "streams": {}}

    def _rows(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(_COLUMNS).parquet(*[f"{self.path}/{p}" for p in places]) if places else self.spark.createDataFrame([], _COLUMNS)

    def _latest(self, deltas: list[dict]) -> DataFrame:
        """The newest row of each key of the deltas."""
        parts = [self._rows([d["folder"]]).withColumn("nth", F.lit(n)) for n, d in enumerate(deltas)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return (last_of_key(rows, ("k",), "nth") if len(parts) > 1 else rows).drop("nth")

    def read(self) -> DataFrame:
        """The table of the newest version; an empty table before the first upsert."""
        return self._read(self._current())

    def _read(self, manifest: dict) -> DataFrame:
        deltas = manifest["deltas"]
        touched = {f for d in deltas for f in d["touched"]}
        out = self._rows([b["file"] for b in manifest["base"] if b["file"] not in touched])
        if deltas:
            latest = self._latest(deltas)
            stale = self._rows([b["file"] for b in manifest["base"] if b["file"] in touched])
            out = out.unionByName(stale.join(latest.select("k"), "k", "left_anti").select(out.columns)).unionByName(latest.select(out.columns))
        return out.select(_NAMES)

    def upsert(self, new: DataFrame, stream: str | None = None, batch: int = 0) -> DataFrame:
        """Upserts rows (CHUNK without id, and seq; the last of a key by seq counts); ValueError, and no change, if the table's rules would break.

        stream and batch: a batch whose number the stream has reached already changes nothing.
        """
        manifest = self._current()
        if stream is not None and manifest["streams"].get(stream, -1) >= batch:
            return self._read(manifest)
        folder = f"d-{uuid.uuid4().hex}"
        rows = last_of_key(new).withColumn("k", sort_key()).withColumn("id", F.xxhash64(*schemas.CHUNK_KEY))
        seen = Observation()
        broken = [F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in schemas.CHUNK_NOT_NULL]
        # Counted in the pass that writes, above the shuffle, so that sampling for ranges does not count.
        rows.select(*_NAMES, "k").repartitionByRange("k").sortWithinPartitions("k").observe(seen, F.count("*").alias("rows"), *broken).write.option("maxRecordsPerFile", ROWS).parquet(f"{self.path}/{folder}")
        found = seen.get
        if any(found[c] for c in schemas.CHUNK_NOT_NULL):
            self._delete(folder)
            raise ValueError("; ".join(f"{c} is null: {found[c]}" for c in schemas.CHUNK_NOT_NULL if found[c]))
        described: list[dict] | None = None
        while True:
            manifest = self._current()
            if (stream is not None and manifest["streams"].get(stream, -1) >= batch) or (stream is None and not found["rows"]):
                self._delete(folder)
                return self._read(manifest)
            after = manifest | {"version": manifest["version"] + 1, "streams": manifest["streams"] | ({stream: batch} if stream is not None else {})}
            if found["rows"] and not manifest["base"]:
                described = described or self._described(folder)
                after["base"] = described
            elif found["rows"]:
                touched, within = self._touched(folder, manifest["base"])
                after["deltas"] = [*manifest["deltas"], {"folder": folder, "rows": found["rows"], "touched": touched, "within": within}]
            if self._publish(after):
                break
        if len(after["deltas"]) > MOST_DELTAS or sum(d["rows"] for d in after["deltas"]) > SHARE * sum(b["rows"] for b in after["base"]):
            self.compact()
        return self.read()

    def _described(self, folder: str) -> list[dict]:
        """Entries of the files of a folder, and their Bloom filters as a table beside it."""
        stored = self._rows([folder]).select("k", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        files = stored.groupBy("path").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("rows"), F.first("bytes").alias("bytes")).collect()  # an entry a file

        def filtered(table: pa.Table) -> pa.Table:
            return pa.table({"name": table.column("name")[:1], "bits": pa.array([bloom(table.column("h").to_numpy())], pa.binary())})

        hashes = stored.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.xxhash64("k").alias("h"))
        filters = f"bloom-{uuid.uuid4().hex}"
        hashes.groupBy("name").applyInArrow(filtered, "name string, bits binary").write.parquet(f"{self.path}/{filters}")  # a group has about ROWS rows
        return [{"file": r.path[r.path.index(folder) :], "lo": r.lo, "hi": r.hi, "rows": r.rows, "bytes": r.bytes, "bloom": filters} for r in files]

    @staticmethod
    def _owned(base: list[dict]):
        """Function from keys to the names of the base files whose ranges they fall in: from a file's least key to the next one's."""
        ordered = sorted((b["lo"], b["file"].rpartition("/")[2]) for b in base)
        least, names = [lo for lo, _ in ordered], [n for _, n in ordered]
        return lambda keys: [names[max(0, bisect_right(least, k) - 1)] for k in keys]

    def _touched(self, folder: str, base: list[dict]) -> tuple[list[str], list[str]]:
        """Base files that may hold a key of a delta, and those in whose range a key of it falls."""
        owned = self._owned(base)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(owned(b.column(0).to_pylist()), pa.string()), b.column(1)], ["name", "h"])

        keys = self._rows([folder]).select("k", F.xxhash64("k").alias("h")).mapInArrow(deal, "name string, h long")
        share = F.pmod("h", F.lit(SHARES)).cast("int").alias("share")
        keys = keys.select("name", share, F.lit(1).alias("kind"), "h", F.lit(None).cast("binary").alias("bits"))
        filters = self.spark.read.schema("name string, bits binary").parquet(*[f"{self.path}/{n}" for n in sorted({b["bloom"] for b in base})])
        filters = filters.select("name", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), "bits")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None
            for b in batches:
                names, kind, h = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
                at = np.flatnonzero(kind == 0)
                for low, high in zip([0, *at], [*at, b.num_rows]):
                    if low < high and kind[low] == 0:
                        bits, low = b.column(3)[low].as_py(), low + 1
                    if low < high:
                        yield pa.RecordBatch.from_arrays([names.slice(low, 1), pa.array([may_hold(bits, h[low:high])])], ["name", "hit"])

        met = keys.unionByName(filters).repartition("name", "share").sortWithinPartitions("name", "share", "kind").select("name", "kind", "h", "bits")
        found = {r.name: r.hit for r in met.mapInArrow(test, "name string, hit boolean").groupBy("name").agg(F.max("hit").alias("hit")).collect()}  # an entry a file
        by_name = {b["file"].rpartition("/")[2]: b["file"] for b in base}
        return sorted(by_name[n] for n, hit in found.items() if hit), sorted(by_name[n] for n in found)

    def compact(self) -> bool:
        """Merges the deltas into the base files in whose range they fell; False if another writer was first, who may compact next."""
        manifest = self._current()
        deltas = manifest["deltas"]
        if not deltas:
            return False
        hit = {f for d in deltas for f in d["within"]}
        kept, old = ([b for b in manifest["base"] if (b["file"] in hit) == side] for side in (False, True))
        owned, latest = self._owned(manifest["base"]), self._latest(deltas)
        columns = [*_NAMES, "k"]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(owned(b.column(len(columns) - 1).to_pylist()), pa.string())], [*columns, "owner"])

        new = latest.select(columns).mapInArrow(deal, f"{_COLUMNS}, owner string")
        stale = self._rows([b["file"] for b in old]).select(*columns, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("owner"))
        rows = stale.join(latest.select("k"), "k", "left_anti").select(*columns, "owner").unionByName(new)
        n = max(1, -(-(sum(b["rows"] for b in old) + sum(d["rows"] for d in deltas)) // ROWS))
        folder = f"b-{uuid.uuid4().hex}"
        # By owner, so that no new file reaches over the range of one that is kept; by key, so that a large range is several files.
        rows.repartitionByRange(n, "owner", "k").sortWithinPartitions("owner", "k").write.option("maxRecordsPerFile", ROWS).partitionBy("owner").parquet(f"{self.path}/{folder}")
        after = manifest | {"version": manifest["version"] + 1, "base": kept + self._described(folder), "deltas": []}
        if self._publish(after):
            return True
        self._delete(folder)
        return False

    def vacuum(self, seconds: float = 86_400) -> None:
        """Deletes older versions, and what no version names and was changed more than so many seconds ago: what running writers stage must be younger."""
        manifest = self._current()
        named = {b["file"].split("/")[0] for b in manifest["base"]} | {b["bloom"] for b in manifest["base"]} | {d["folder"] for d in manifest["deltas"]}
        named |= {f"manifest-{manifest['version']}", f"table-{manifest['version']}"}
        for name, age in self._listed():
            old = name.startswith("manifest-") or age >= seconds
            if name not in named and name.split("-")[0] in ("manifest", "d", "b", "bloom", "table", "_part") and old:
                self._delete(name)

    def register(self, table: str = "paper_chunks", database: str = "paper_chunks") -> None:
        """Makes the newest version a table of the catalog, written as one folder, its required columns NOT NULL; register again after an upsert."""
        manifest = self._current()
        if not manifest["version"]:
            raise ValueError(f"{self.path} has no version yet")
        location = f"{self.path}/table-{manifest['version']}"
        if not self._fs.exists(self._path(f"{location}/_SUCCESS")):
            self._read(manifest).write.mode("overwrite").parquet(location)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        self.spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")
        columns = [f.split(" ") for f in schemas.CHUNK.split(", ")]
        typed = ", ".join(f"`{n}` {t}" + " NOT NULL" * (n in schemas.CHUNK_NOT_NULL) for n, t in columns)
        self.spark.sql(f"CREATE TABLE `{database}`.`{table}` ({typed}) USING parquet LOCATION '{location}'")
