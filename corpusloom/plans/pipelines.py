"""Whole runs over files: build a corpus, rewrite, merge, index, answer, score, generate questions.

Each takes paths and leaves its result at a path, so that runs are coupled through tables only, and one can be resumed.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import alternatives, question_form, strip
from ..functions.urls import normalise
from ..operators import chunk, crawl, evaluate, generate, index, merge, neardup
from ..schemas import DOCUMENT, PROGRESS, QA
from ..sources import fetch, jsonl
from ..storage import numbered, removed, written


def with_chunk_ids(rows: DataFrame) -> DataFrame:
    """rows with a chunk_id by order of document, section and part, however many a document has; written once."""
    return numbered(rows, ["doc_id", "section_idx", "part_idx"], "chunk_id")


def with_doc_ids(docs: DataFrame) -> DataFrame:
    """docs with a doc_id by order of URL, written once."""
    return numbered(docs, ["url"], "doc_id")


def in_batches(rows: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """rows in parts of about `size`, dealt out by a hash of the key: what is done of one part is on record before the next begins."""
    n = -(-rows.count() // size)
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else rows


def crawl_site(spark: SparkSession, seeds: list[str], domain: str, out: str, fetcher: fetch.Fetcher | fetch.Archive, budget: int = 5000, resume: bool = False, batch: int = 500) -> None:
    """Pages of a site as a table of (url, html). Every batch is added to it when it is fetched, so that a run that broke off can go on."""
    stored = spark.read.parquet(out) if resume and _exists(spark, out) else None
    crawl.crawl(spark, seeds, fetcher, domain, budget, stored, batch=batch, each=lambda got: jsonl.write_pages(got, out))


def build_corpus(spark: SparkSession, pages: DataFrame, corpus: str, chunks: str, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> None:
    """Parses each of (url, html) once; writes documents of 50 characters or more, and their passages."""
    parsed = pages.select("url", H.parsed("html").alias("p")).select("url", "p.*").where(F.char_length("text") >= chunk.LEAST_CHARS)
    docs = with_doc_ids(parsed)
    jsonl.write_jsonl(docs.select("url", "title", "text"), corpus)
    jsonl.write_jsonl(with_chunk_ids(chunk.chunks(docs, size, overlap, F.col("sections"))).select("chunk_id", "url", "title", "section", "text"), chunks)


def chunk_corpus(spark: SparkSession, corpus: str, chunks: str, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> None:
    """Passages of a stored corpus; malformed lines are skipped."""
    # passages are put in order by URL and place; documents aren't numbered first, as their texts would be sorted and written for it
    docs = jsonl.read_tolerant(spark, corpus, DOCUMENT).withColumn("doc_id", F.struct("url", F.monotonically_increasing_id().alias("place")))
    jsonl.write_jsonl(with_chunk_ids(chunk.chunks(docs, size, overlap)).select("chunk_id", "url", "title", "section", "text"), chunks)


def rewrite_corpus(spark: SparkSession, corpus: str, log: str, out: str, generator: Callable[[str], str | None], workers: int = 10, retry_failed: bool = False, batch: int = 1000) -> DataFrame:
    """Rewrites the documents that the log lacks, adds each batch of them to it, and writes the corpus with the log's texts. Returns the counters. A run that broke off goes on after its last batch."""
    docs = jsonl.read_tolerant(spark, corpus, DOCUMENT)
    done = progress_log(spark, log)
    if retry_failed:
        done = done.where("llm_cleaned")
    first = jsonl.next_batch(spark, log) if _exists(spark, log) else 1
    for n, part in enumerate(in_batches(written(merge.pending(docs, done, "url"), "pending"), "url", batch), first):
        jsonl.append_log(generate.rewritten(part, generator, workers).withColumn("batch", F.lit(n).cast("long")), log)
    done = progress_log(spark, log)
    jsonl.write_jsonl(merge.assembled(docs, done, "url", ("title", "text")).select("url", "title", "text"), out)
    known = merge.finished(docs, done, "url").withColumn("cut", F.char_length(F.coalesce("text_original", F.lit(""))) > generate.REWRITE_CHARS)
    return merge.counters(known, done="true", cleaned="llm_cleaned", failed="not llm_cleaned", cut_off="cut")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each URL of a progress log, which may not exist yet: of the last batch, then by place. Entries without a batch come first."""
    if not _exists(spark, path):
        return spark.createDataFrame([], PROGRESS)
    rows = jsonl.read_tolerant(spark, path, PROGRESS + ", batch long", placed="_at")
    rows = rows.withColumn("_order", F.struct(F.coalesce("batch", F.lit(0)).alias("batch"), "_at")).drop("batch", "_at")
    return merge.last_wins(rows, "url", order="_order").drop("_order")


def merge_corpora(spark: SparkSession, ours: str, theirs: str, out: str, extra_urls: DataFrame | None = None, fetcher: fetch.Fetcher | fetch.Archive | None = None, keep_title: bool = True) -> None:
    """Our documents, theirs of other URLs, and pages of extra URLs that neither has; texts of 30 characters or fewer go."""

    def read(path: str) -> DataFrame:
        rows = jsonl.read_tolerant(spark, path, DOCUMENT, placed="ord")
        return rows.select(normalise(F.col("url"), True).alias("key"), "url", "title", "text", "ord")

    merged = merge.by_priority(read(ours), read(theirs), "key").select("url", "title", "text")
    if extra_urls is not None and fetcher is not None:
        got = fetch.fetch(merge.missing(extra_urls, merged), fetcher).where("html is not null")
        fresh = got.select("url", F.lit("").alias("title"), H.quick("html").alias("text")).where(F.char_length("text") > chunk.LEAST_CHARS)
        merged = merged.unionByName(fresh)
    rows = merged.where(F.char_length("text") > 30)
    jsonl.write_jsonl(rows if keep_title else rows.drop("title"), out)


def build_index(spark: SparkSession, chunks: str, out: str) -> None:
    """The index of a file of passages, and the passages. Blank passages go; a malformed line is an error."""
    rows = jsonl.read_strict(spark, chunks, "chunk_id long, url string, title string, section string, text string")
    rows = rows.where(strip(F.coalesce("text", F.lit(""))) != "")
    rows.write.mode("overwrite").parquet(f"{out}/chunks")
    index.write_index(spark.read.parquet(f"{out}/chunks"), out)


def answer_questions(spark: SparkSession, questions: str, where: str, out: str, generator: generate.Generator = generate.stub, k: int = index.TOP, parallel: int | None = None) -> None:
    """One answer a line for one question a line; blank questions and failures are `unknown`."""
    asked = jsonl.read_lines(spark, questions, "question", strip=True).withColumnRenamed("pos", "q")
    chunks = spark.read.parquet(f"{where}/chunks")
    ranked = index.top_k(asked, chunks, k, index.read_index(spark, where))
    done = generate.answers(generate.prompts(ranked, chunks, asked), generator, parallel)
    jsonl.write_lines(done.withColumnRenamed("q", "pos"), out, "prediction")


def score_answers(spark: SparkSession, predictions: str, gold: str, where: str | None = None, k: int = index.TOP) -> DataFrame:
    """(n, em, f1, recall) of answers by line; recall is of the index's passages, and null without one."""
    guessed = jsonl.read_lines(spark, predictions, "prediction")
    lines = jsonl.read_lines(spark, gold, "line").where("trim(line) <> ''")
    known = numbered(lines, ["pos"], "n").select("n", F.from_json("line", QA, {"mode": "FAILFAST"}).alias("r")).select(F.col("n").alias("pos"), "r.*")
    report = evaluate.report(evaluate.scored(guessed, known))
    if where is None:
        return report.withColumn("recall", F.lit(None).cast("double"))
    asked = known.join(guessed, "pos").select(F.col("pos").alias("q"), "question", alternatives(F.col("answer")).alias("answers"))
    chunks = spark.read.parquet(f"{where}/chunks")
    hits = evaluate.hits(index.top_k(asked, chunks, k, index.read_index(spark, where)), chunks, asked.select("q", "answers"), k)
    return report.crossJoin(hits.agg(F.avg(F.col("hit").cast("double")).alias("recall")))


def formatted(report: DataFrame) -> str:
    """The report's numbers to four decimals."""
    row = report.first().asDict()
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.items() if v is not None)


#: Fixed value: the version of the dataset that the scorer is for.
SQUAD_VERSION = "1.1"


def score_squad(spark: SparkSession, dataset: str, predictions: str) -> DataFrame:
    """(exact_match, f1, total) in percent. A dataset of another version is scored, with a warning."""
    version = jsonl.read_squad_version(spark, dataset)
    if version != SQUAD_VERSION:
        warnings.warn(f"scores are for version {SQUAD_VERSION} of the dataset, this is {version}", stacklevel=2)
    return evaluate.squad_report(jsonl.read_squad(spark, dataset), jsonl.read_predictions(spark, predictions))


def generate_questions(
    spark: SparkSession, categories: DataFrame, domain: str, log: str, out: str, fetcher: fetch.Fetcher | fetch.Archive, generator: Callable[[str], str | None], seed: int = 0, batch: int = 1000
) -> DataFrame:
    """Crawls each category, asks for questions on pages that the log lacks, adds each batch of them to it, and writes the ones that hold up, shuffled. Returns counts by category."""
    pages = written(crawl.crawl_categories(spark, categories, fetcher, domain).select("category", "url", H.for_questions("html").alias("text")), "pages")
    schema = QA + ", category string, ord long"
    done = jsonl.read_tolerant(spark, log, schema) if _exists(spark, log) else spark.createDataFrame([], schema)
    fresh = merge.pending(pages.where(F.char_length("text") >= generate.PAGE_CHARS), done, "url")
    asked = generate.planned(fresh, categories.select("category", "cap", "n_q", "hint"))
    asked = written(asked.withColumn("prompt", generate.question_prompt(F.col("text"), F.col("url"), F.col("hint"), F.col("n_q"))).select("category", "url", "prompt"), "asked")
    for part in in_batches(asked, "url", batch):
        raw = written(generate.generated(part, "prompt", generator).where("raw is not null"), "raw")
        pairs = generate.parsed_pairs(raw).join(raw.select("url", "category").distinct(), "url")
        jsonl.append_log(pairs.select("question", "answer", "url", "category", F.xxhash64("url", "line_no").alias("ord")), log)
        removed(raw)
    if not _exists(spark, log):
        jsonl.append_log(spark.createDataFrame([], schema), log)
    logged = jsonl.read_tolerant(spark, log, schema)
    good = generate.validated(logged, pages.select("url", "text").dropDuplicates(["url"]))
    kept = neardup.kept(good, form=question_form)
    jsonl.write_jsonl(generate.shuffled(kept.select("question", "answer", "url"), "question", seed), out)
    return logged.groupBy("category").agg(F.count("*").alias("n"))
