"""Command line: python -m corpusloom COMMAND ..., or spark-submit with this file."""

from __future__ import annotations

import argparse

from .operators.chunk import OVERLAP, SIZE
from .operators.index import TOP


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    to = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **options) -> None:
        p = to.add_parser(name)
        for x in paths:
            p.add_argument(x)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)

    command("crawl", "seeds", "out", domain=None, max_pages=5000, delay=0.4)
    command("corpus", "manifest", "raw", "corpus", "chunks", chunk_size=SIZE, overlap=OVERLAP)
    command("chunk", "corpus", "chunks", chunk_size=SIZE, overlap=OVERLAP)
    command("rewrite", "corpus", "log", "out", endpoint=None, workers=10, delay=0.3)
    command("merge", "ours", "theirs", "out")
    command("index", "chunks", "out")
    command("answer", "questions", "index", "out", endpoint=None, k=TOP)
    command("score", "predictions", "gold", index=None, k=TOP)
    command("squad", "dataset", "predictions")
    return top


def main(argv: list[str] | None = None, spark=None) -> str | None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators import generate
    from .plans import pipelines as P
    from .sources import fetch, jsonl

    spark = spark or SparkSession.builder.appName(f"corpusloom {args.command}").getOrCreate()
    model = generate.chat_model(args.endpoint) if getattr(args, "endpoint", None) else generate.stub
    if args.command == "crawl":
        seeds = [r.url for r in spark.read.text(args.seeds).toDF("url").collect() if r.url.strip()]  # a short list that a person wrote
        P.crawl_site(spark, seeds, args.domain, args.out, fetch.polite(fetch.http_fetcher(), args.delay), args.max_pages)
    elif args.command == "corpus":
        P.build_corpus(spark, jsonl.read_pages(spark, jsonl.read_manifest(spark, args.manifest), args.raw), args.corpus, args.chunks, args.chunk_size, args.overlap)
    elif args.command == "chunk":
        P.chunk_corpus(spark, args.corpus, args.chunks, args.chunk_size, args.overlap)
    elif args.command == "rewrite":
        return P.formatted(P.rewrite_corpus(spark, args.corpus, args.log, args.out, fetch.polite(model, args.delay), args.workers))
    elif args.command == "merge":
        P.merge_corpora(spark, args.ours, args.theirs, args.out)
    elif args.command == "index":
        P.build_index(spark, args.chunks, args.out)
    elif args.command == "answer":
        P.answer_questions(spark, args.questions, args.index, args.out, model, args.k)
    elif args.command == "score":
        return P.formatted(P.score_answers(spark, args.predictions, args.gold, args.index, args.k))
    else:
        return P.score_squad(spark, args.dataset, args.predictions).toJSON().first()
    return None


if __name__ == "__main__":
    said = main()
    if said:
        print(said)
