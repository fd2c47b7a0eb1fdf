"""What a task that parses articles holds."""

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lectern.sources import jats


def test_records_are_held_in_bounded_batches():
    schema = to_arrow_schema(_parse_datatype_string(jats.RAW_PAPER))
    small = b"<article><front><article-meta><article-id pub-id-type='pmc'>1</article-id></article-meta></front></article>"
    files = pa.RecordBatch.from_pydict({"path": [f"/in/{k}.xml" for k in range(3000)], "content": [small if k % 10 else b"<x/>" for k in range(3000)]})
    sizes, before = [], pa.total_allocated_bytes()
    for out in jats.records(iter([files]), schema):
        sizes.append(out.num_rows)
        assert pa.total_allocated_bytes() - before < 1 << 20
    assert sum(sizes) == 3000 and max(sizes) <= jats.BATCH_FILES
    # Files whose size fills a batch, and one whose record Arrow can't hold.
    big = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [small.replace(b">1<", b">" + b"1" * jats.BATCH_BYTES + b"<")] * 2})
    assert [out.num_rows for out in jats.records(iter([big]), schema)] == [1, 1]
    rows = pa.Table.from_batches(jats._batches([{"file": "a", "title": "t"}, {"file": "b", "title": "\ud800"}], schema)).to_pylist()
    assert [r["file"] for r in rows] == ["a", "b"] and rows[0]["title"] == "t" and rows[1]["error"] and rows[1]["title"] is None
