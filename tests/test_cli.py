import random

import public_tokenizers
import pytest

from lectern import cli
from lectern.sources.corpus import ChunkStore

ARTICLE = "<article><front><article-meta><article-id pub-id-type='pmid'>{0}</article-id><title-group><article-title>Paper {0}</article-title></title-group></article-meta></front><body><sec><title>Results</title><p>rats and mice number {0}</p></sec></body></article>"


def shortened(prompt, rules):
    assert "provided context" in rules
    return prompt.strip().splitlines()[-1].upper() + "⟦S:1⟧"


def test_from_files_to_answer(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "list.csv").write_text("Key,AccessionID,License\n" + "".join(f"k{k}.xml,A{k},x\n" for k in range(20)))
    assert cli.main(["sample", "--filelist", str(tmp_path / "list.csv"), "--out_dir", str(tmp_path), "--n", "3", "--seed", "5"]) == 0
    keys = [r.Key for r in spark.read.option("header", True).csv(str(tmp_path / "manifest")).collect()]
    assert keys == [f"k{k}.xml" for k in random.Random(5).sample(range(20), 3)]

    (tmp_path / "xml").mkdir()
    for k in range(3):
        (tmp_path / "xml" / f"{k}.xml").write_text(ARTICLE.format(k))
    assert cli.main(["parse", "--input", str(tmp_path / "xml"), "--out_dir", str(tmp_path)]) == 0
    assert cli.main(["chunk", "--corpus", str(tmp_path / "corpus.jsonl"), "--store", str(tmp_path / "store"), "--tokenizer", public_tokenizers.path("byte_bpe_50k.json")]) == 0
    assert "3 chunks, 0 in quarantine" in capsys.readouterr().out
    asked = iter(["mice", "out"])
    monkeypatch.setattr("builtins.input", lambda _: next(asked))
    assert cli.main(["ask", "--store", str(tmp_path / "store"), "--top-papers", "2"]) == 0
    assert "[S:1] Paper: " in capsys.readouterr().out
    (tmp_path / "none").mkdir()
    with pytest.raises(SystemExit):
        cli.main(["parse", "--input", str(tmp_path / "none"), "--out_dir", str(tmp_path)])


def test_fetch_download_single_and_questions(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    for k in range(4):
        (tmp_path / "src" / f"{k}.xml").write_text(ARTICLE.format(k))
    (tmp_path / "src" / "list.csv").write_text("Key,AccessionID,License\n" + "".join(f"{k}.xml,A{k},x\n" for k in (0, 1, 2, 3, 9)))
    copy = f"cp {tmp_path}/src/{{key}} {{destination}}"
    assert cli.main(["metadata", "--source", f"{tmp_path}/src/list.csv", "--out_dir", str(tmp_path), "--fetch", "cp {key} {destination}"]) == 0
    assert cli.main(["metadata", "--source", "nothing/none.csv", "--out_dir", str(tmp_path), "--fetch", "cp {key} {destination}"]) == 1
    assert cli.main(["download", "--filelist", str(tmp_path / "list.csv"), "--out_dir", str(tmp_path / "got"), "--existing", "--fetch", copy]) == 0
    assert "4 fetched, 1 failed, 4 XML files" in capsys.readouterr().out
    assert [r.Key for r in spark.read.option("header", True).csv(str(tmp_path / "got/failed_downloads")).collect()] == ["9.xml"]
    assert cli.main(["parse", "--input", str(tmp_path / "got" / "2.xml"), "--out_dir", str(tmp_path), "--single"]) == 0
    assert spark.read.json(str(tmp_path / "paper.json")).first().paper_id == "2"
    assert cli.main(["parse", "--input", str(tmp_path / "got"), "--out_dir", str(tmp_path)]) == 0
    assert cli.main(["chunk", "--corpus", str(tmp_path / "corpus.jsonl"), "--store", str(tmp_path / "store"), "--tokenizer", public_tokenizers.path("byte_bpe_50k.json"), "--provider", "hashing", "--index", str(tmp_path / "lexical")]) == 0
    trained = f"trained:{tmp_path}/vectors"
    corpus = (tmp_path / "corpus.jsonl").read_text() if (tmp_path / "corpus.jsonl").is_file() else "".join(p.read_text() for p in sorted((tmp_path / "corpus.jsonl").glob("part-*")))
    (tmp_path / "more.jsonl").write_text(corpus + "no record\n")
    capsys.readouterr()
    assert cli.main(["chunk", "--corpus", str(tmp_path / "more.jsonl"), "--store", str(tmp_path / "by_training"), "--tokenizer", public_tokenizers.path("byte_bpe_50k.json"), "--train", str(tmp_path / "vectors")]) == 0
    assert "4 chunks, 1 in quarantine" in capsys.readouterr().out
    store = ChunkStore(spark, str(tmp_path / "by_training"))
    assert {len(r.embedding) for r in store.read().collect()} == {768}
    assert cli.main(["chunk", "--corpus", str(tmp_path / "more.jsonl"), "--store", str(tmp_path / "by_training"), "--tokenizer", public_tokenizers.path("byte_bpe_50k.json"), "--provider", trained]) == 0
    assert store.read().count() == 4
    (tmp_path / "q.txt").write_text("mice\n\nrats\n")
    assert cli.main(["ask", "--store", str(tmp_path / "store"), "--index", str(tmp_path / "lexical"), "--generator", "test_cli:shortened", "--questions", str(tmp_path / "q.txt")]) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["MICE", "RATS"]
