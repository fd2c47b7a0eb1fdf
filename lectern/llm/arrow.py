"""Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.runtime import bound_batches, ship

def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id bigint, text string), whatever other columns ``docs`` has."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they have ``most`` bytes; all as they are if that is 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held = []
    if held:
        yield pa.concat_batches(held)


def map_rows(df: DataFrame, per_batch: Callable[[Callable[[pa.RecordBatch], dict]], dict], ddl: str, gather: int = 0) -> DataFrame:
    """mapInArrow whose function turns a batch into a dict of columns named as in ``ddl``.

    ``per_batch`` is called once per task and returns the function for each batch, or for
    batches put together until they have ``gather`` bytes.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    kind = _parse_datatype_string(ddl)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = per_batch()
        for batch in _gathered(batches, gather):
            out = one(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, kind)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()
