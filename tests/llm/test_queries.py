"""The registered queries on the small tables: contracts, and oracles where there are any."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries
from lectern.llm.oracles import ORACLES
from lectern.runtime import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CONTRACT = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_language": "doc_id held_out lang_pred score",
    "op5_suffix": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_neardup": "doc_id n_shingles component_id kept",
    "op11_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op12_align": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.columns[: len(CONTRACT[name].split())] == CONTRACT[name].split()
    conversations = load(spark, SF, "conversations").select("conv_id").distinct().count()
    whole = {"op3_chat": conversations + 1, "op13_repair": conversations}.get(name) or load(spark, SF, "documents").count()
    assert out.count() == whole


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    names = [d[0] for d in found.description]
    want = sorted(str([dict(zip(names, r))[c] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in queries.QUERIES[name](spark, SF).collect()) == want


def test_extra_conversation_reads_back(spark):
    row = queries.op3_chat(spark, SF).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_folds(spark):
    for name, modulus, fold in (("op4_language", 4, 2), ("op7_toxicity", 5, 0)):
        out = queries.QUERIES[name](spark, SF)
        assert out.where((F.crc32(F.col("doc_id").cast("string")) % modulus == fold) != F.col("held_out")).count() == 0
