"""Windows over tokens: edges against the native form, and how much text is cut at once."""

import numpy as np
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import chunking


def test_offsets_stay_in_bounded_pieces(spark):
    def load():
        words = chunking.word_tokenizer()

        def run(texts):
            assert sum(map(len, texts)) < chunking.PIECE + 1000
            return words(texts)

        return run

    text = " ".join(f"w{k}" for k in range(200))
    papers = spark.range(2000).coalesce(1).select(F.concat(F.lit("p"), "id").alias("paper_id"), F.lit("a title").alias("title"), F.lit(text).alias("abstract"), F.array().cast(schemas.SECTIONS).alias("sections"))
    found, bad = chunking.chunks(papers, chunking.offsets_udf(load), 100, 20)
    want = [" ".join(text.split()[k : k + 98]) for k in (0, 78, 156)]
    got = found.where("paper_id = 'p1999'").orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == ["a title\n\n" + w for w in want] and found.count() == 6000 and bad.count() == 0


def test_edges_equal_window_starts(spark):
    cases = [(n, h, w, o) for n in (0, 1, 8, 30) for h in (0, 3, 9) for w, o in ((8, 3), (8, 0), (8, 20))]
    for n, h, w, o in cases:
        starts = spark.range(1).select(chunking.window_starts(F.lit(n), F.lit(h), w, o).alias("s")).first().s or []
        at = np.array([(10 * k, 10 * k + 5) for k in range(n)], np.int32).reshape(-1, 2)
        assert chunking.edges(at, h, w, o).tolist() == [[10 * k, 10 * (min(k + w - h, n) - 1) + 5] for k in starts]
