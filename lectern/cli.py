"""Command line: fetch a file list, sample and download articles, parse, chunk and embed them, ask questions."""

from __future__ import annotations

import argparse
import importlib
import shlex

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from lectern.runtime import cut, discard, written


def _plugin(name: str):
    """The object that ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _provider(spark: SparkSession, name: str):
    """hashing, trained:FOLDER (vectors that chunk --train keeps), sentence:MODEL, or a provider of your own as module:attribute."""
    from lectern.operators import embedding, lsa

    if name == "hashing":
        return embedding.hashing_provider()
    if name.startswith("trained:"):
        return lsa.provider(spark, lsa.load(spark, name.partition(":")[2]))
    if name.startswith("sentence:"):
        return embedding.sentence_provider(name.partition(":")[2])
    return _plugin(name)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("metadata", help="fetch the file list with a command")
    p.add_argument("--source", required=True)
    p.add_argument("--out_dir", default=".")
    p.add_argument("--fetch", required=True, help="a command with {key} and {destination}")
    for verb in ("sample", "download"):
        p = sub.add_parser(verb)
        p.add_argument("--filelist", required=True)
        p.add_argument("--out_dir", required=True)
        p.add_argument("--n", type=int, default=10)
        p.add_argument("--seed", type=int, default=42)
        if verb == "download":
            p.add_argument("--existing", action="store_true", help="download the whole list, without a sample")
            p.add_argument("--fetch", required=True, help="a command with {key} and {destination}")
    p = sub.add_parser("parse")
    p.add_argument("--input", required=True)
    p.add_argument("--out_dir", required=True)
    p.add_argument("--no-sibling-inherit", action="store_true")
    p.add_argument("--single", action="store_true", help="one article as one JSON document")
    p = sub.add_parser("chunk")
    p.add_argument("--corpus", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--tokenizer", required=True, help="a tokenizers JSON file")
    p.add_argument("--index", help="a folder whose lexical index follows the store")
    p.add_argument("--provider", default="hashing", help=_provider.__doc__)
    p.add_argument("--train", help="train vectors on these chunks, keep them in this folder and embed with them; further chunks of the store want --provider trained:FOLDER")
    p = sub.add_parser("ask")
    p.add_argument("--store", required=True)
    p.add_argument("--provider", default="hashing", help=_provider.__doc__)
    p.add_argument("--generator", help="module:attribute of a function of prompt and rules; without it the prompt is shown")
    p.add_argument("--index", help="the lexical index that chunk --index keeps; without it one is made for the session")
    p.add_argument("--questions", help="a file with a question on each line, instead of asking for them")
    for name, default in (("--top-chunks", 3), ("--top-papers", 5), ("--evidence", 3)):
        p.add_argument(name, type=int, default=default)
    args = top.parse_args(argv)
    if args.command == "metadata":
        return _metadata(args)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    return {"sample": _sample, "download": _download, "parse": _parse, "chunk": _chunk, "ask": _ask}[args.command](spark, args)


def _metadata(args) -> int:
    from lectern.sources.objects import command_fetcher

    name = args.source.rpartition("/")[2]
    ok = command_fetcher(*shlex.split(args.fetch))(args.source, f"{args.out_dir.rstrip('/')}/{name}")
    print(f"{'fetched' if ok else 'could not fetch'} {args.source}")
    return 0 if ok else 1


def _sample(spark: SparkSession, args) -> int:
    from lectern.sources import filelist

    sample = filelist.sample_files(filelist.read_file_list(spark, args.filelist), args.n, args.seed)
    filelist.write_manifest(sample, f"{args.out_dir}/manifest")
    return 0


def _download(spark: SparkSession, args) -> int:
    from lectern.sources import filelist, objects

    files = filelist.read_file_list(spark, args.filelist)
    if not args.existing:
        files = cut(filelist.sample_files(files, args.n, args.seed))
        filelist.write_manifest(files, f"{args.out_dir}/manifest")
    seen = Observation()
    fetched = objects.fetch(files, args.out_dir, objects.command_fetcher(*shlex.split(args.fetch)))
    done = written(fetched.observe(seen, F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")))  # each object once
    if seen.get["bad"]:
        filelist.write_failures(done.where("not ok"), f"{args.out_dir}/failed_downloads")
    discard(done)
    print(f"{seen.get['good']} fetched, {seen.get['bad']} failed, {objects.count_xml_files(spark, args.out_dir)} XML files in {args.out_dir}")
    return 0


def _parse(spark: SparkSession, args) -> int:
    from lectern.sources import corpus, jats, objects

    files = objects.xml_files(spark, args.input)
    if files.isEmpty():
        raise SystemExit(f"no .xml files under {args.input}")
    good, errors = jats.papers(files, inherit=not args.no_sibling_inherit, once=True)
    if args.single:
        corpus.write_single_json(good, f"{args.out_dir}/paper.json")
    else:
        corpus.write_jsonl(good, errors, f"{args.out_dir}/corpus.jsonl")
    return 0


def _chunk(spark: SparkSession, args) -> int:
    from lectern.operators import chunking, embedding, lsa
    from lectern.sources import corpus

    lines, parts = Observation(), Observation()
    papers, _ = corpus.read_jsonl(spark, args.corpus, lines)
    with open(args.tokenizer, encoding="utf-8") as f:
        offsets = chunking.offsets_udf(chunking.library_tokenizer(f.read()))
    found = written(chunking.chunks(papers, offsets, seen=parts)[0])  # one pass over the corpus, whose metrics count what is left out
    if args.train:
        lsa.fit(found, "chunk_text").save(spark, args.train)
    store = corpus.ChunkStore(spark, args.store)
    store.upsert(embedding.embedded(found, _provider(spark, f"trained:{args.train}" if args.train else args.provider)))
    if args.index:
        from lectern.operators import lexical, upsert
        from lectern.schemas import CHUNK_KEY

        lexical.LexicalIndex(spark, args.index).upsert(upsert.last_of_key(found).withColumn("chunk_id", F.xxhash64(*CHUNK_KEY)))  # the store's ids
    discard(found)
    print(f"{store.read().count()} chunks, {(lines.get['bad'] or 0) + (parts.get['bad'] or 0)} in quarantine")
    return 0


def _ask(spark: SparkSession, args) -> int:
    from lectern.plans.ask import Asker
    from lectern.sources.corpus import ChunkStore

    generate = _plugin(args.generator) if args.generator else None
    asker = Asker(ChunkStore(spark, args.store).read(), _provider(spark, args.provider), generate, args.top_chunks, args.top_papers, args.evidence, index_path=args.index)
    if args.questions:
        with open(args.questions, encoding="utf-8") as f:
            print("\n".join(asker.ask_many([q.strip() for q in f if q.strip()])))
    else:
        while (question := input("Question (out to end): ")) != "out":
            print(asker.ask(question))
    asker.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
