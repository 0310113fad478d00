"""Queries of whole runs: tables are written as the files that a run takes, and what it left is read back.

They cover what queries on tables can't: readers, writers, logs that are resumed, crawls. Every folder is new, in the shared folder.
Files get what readers have rules for (blank and broken lines, blank passages, pages that are missing), on both sides alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import crawl, generate
from ..schemas import CHUNK
from ..sources import fetch, jsonl
from ..storage import fresh_path, numbered, written
from . import catalogue as C
from . import pipelines as P

SITE = f"http://{C.DOMAIN}"
#: Links of a page to pages in the crawled site, which has the form of a heap.
CHILDREN = 8
#: Pages that the categories of a crawl may try; null: the default.
CAPS = {"c0": None, "c1": 40, "c2": 1_000_000}


def run_jsonl_scan(spark, sf_dir):
    """Documents as JSON Lines, between blank and broken lines and records without a key, through the tolerant reader."""
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("title"), "text")
    good = F.to_json(F.struct("url", "title", "text"))
    lines = F.array(good, F.lit(""), F.lit("  \t"), F.concat(F.lit('{"url": '), "url"), F.lit('{"title": "no key"}'))
    path = fresh_path(spark, "scan")
    docs.select(F.explode(lines).alias("value")).write.text(path)
    return jsonl.read_tolerant(spark, path).select("url", "title", F.md5("text").alias("text_md5"))


SCAN_SQL = "SELECT doc_id::VARCHAR AS url, source AS title, md5(text) AS text_md5 FROM documents"


def run_chunk_corpus(spark, sf_dir):
    """A corpus file to a file of numbered passages."""
    url = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    path = fresh_path(spark, "corpus")
    jsonl.write_jsonl(C.table(spark, sf_dir, "documents").select(url.alias("url"), F.lit("T").alias("title"), "text"), f"{path}/corpus")
    P.chunk_corpus(spark, f"{path}/corpus", f"{path}/chunks")
    return jsonl.read_strict(spark, f"{path}/chunks", CHUNK).select("chunk_id", "url", "section", F.md5("text").alias("text_md5"))


CHUNK_CORPUS_SQL = f"""
WITH s AS ({C.SLIDING_SQL}),
u AS (SELECT COALESCE(source, '') || '/' || lpad(doc_id::VARCHAR, 12, '0') AS url, doc_id FROM documents)
SELECT row_number() OVER (ORDER BY url, part_idx) - 1 AS chunk_id, url, section, text_md5 FROM s JOIN u USING (doc_id)
"""


def run_answers(spark, sf_dir):
    """Passages and questions as files, blank passages among them; a stored index; answers as a file of lines."""
    path = fresh_path(spark, "answers")
    docs = C.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("url"), F.lit("").alias("title"), F.lit("").alias("section"), "text")
    blank = docs.select((-1 - F.col("doc_id")).alias("chunk_id"), F.lit("").alias("url"), F.lit("").alias("title"), F.lit("").alias("section"), F.lit(" \n\t").alias("text"))
    jsonl.write_jsonl(rows.unionByName(blank), f"{path}/chunks")
    P.build_index(spark, f"{path}/chunks", f"{path}/index")
    asked = C.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("  "), F.regexp_replace("text", jsonl.LINE_END, " "), F.lit(" ")).alias("question"))
    jsonl.write_lines(asked, f"{path}/questions", "question", "item_id")
    P.answer_questions(spark, f"{path}/questions", f"{path}/index", f"{path}/answers")
    return jsonl.read_lines(spark, f"{path}/answers", "prediction")


ANSWERS_SQL = f"""
WITH kept AS (SELECT * FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
a AS ({C.ANSWER_BATCH_SQL.replace("documents", "kept")})
SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, prediction FROM a
"""


def run_progress_log(spark, sf_dir):
    """Events as a log in three batches, the first without numbers, with broken lines in between: the last entry of every user."""
    path = fresh_path(spark, "log")
    events = C.table(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 3)
    entry = events.groupBy("n", F.col("user_id").cast("string").alias("url")).agg(F.max_by(F.struct("event_type", "event_id"), "event_id").alias("r"))
    entry = entry.select("n", "url", F.col("r.event_type").alias("title"), F.col("r.event_id").cast("string").alias("text"), (F.col("r.event_id") % 2 == 0).alias("llm_cleaned"))
    for n in range(3):
        rows = entry.where(F.col("n") == n).drop("n")
        jsonl.append_log(rows if n == 0 else rows.withColumn("batch", F.lit(jsonl.next_batch(spark, path))), path)
        rows.select(F.concat(F.lit('{"url": "broken '), "url").alias("value")).write.mode("append").text(path)
    return P.progress_log(spark, path).select("url", "title", "text", "llm_cleaned")


LOG_SQL = """
SELECT user_id::VARCHAR AS url, event_type AS title, event_id::VARCHAR AS text, event_id % 2 = 0 AS llm_cleaned FROM events
WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1
"""


def run_merge(spark, sf_dir):
    """Two corpus files and URLs that neither has, whose pages are fetched, to a merged one. Ours has half of theirs, with texts of its own."""
    path = fresh_path(spark, "merge")
    docs = C.table(spark, sf_dir, "documents").select(F.concat(F.lit("http://docs.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title"), "text", "doc_id")
    jsonl.write_jsonl(docs.where("doc_id % 2 = 0").drop("doc_id"), f"{path}/ours")
    jsonl.write_jsonl(docs.withColumn("text", F.concat(F.lit("their "), "text")).drop("doc_id"), f"{path}/theirs")
    pages = C.table(spark, sf_dir, "pages").select(F.concat(F.lit("http://pages.example/p"), F.col("page_id").cast("string")).alias("url"), "html")
    asked = pages.select("url").unionAll(docs.select(F.concat("url", F.lit("?again=1"))))
    P.merge_corpora(spark, f"{path}/ours", f"{path}/theirs", f"{path}/out", asked, fetch.Archive(pages))
    return jsonl.read_tolerant(spark, f"{path}/out").select("url", F.md5("text").alias("text_md5"))


MERGE_SQL = f"""
WITH p AS ({C.PAGE_TEXT_SQL}),
d AS (SELECT 'http://docs.example/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'their ' || text END AS text FROM documents)
SELECT url, md5(text) AS text_md5 FROM d WHERE length(text) > 30
UNION ALL SELECT 'http://pages.example/p' || page_id, md5(text) FROM p WHERE length(text) > 50
"""


def _heap(spark, sf_dir, own_links: bool):
    """(k, page_id, html): pages numbered from 1, each with links to CHILDREN others before its own."""
    rows = numbered(C.table(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"], "k").withColumn("k", F.col("k") + 1)
    return rows if own_links else rows.withColumn("html", F.regexp_replace("html", "(?i)<a ", "<b "))


def _links(k, stem: str):
    first = (k - 1) * CHILDREN + 2
    return F.array_join(F.transform(F.sequence(first, first + CHILDREN - 1), lambda c: F.concat(F.lit(f'<a href="{stem}'), c.cast("string"), F.lit('">x</a>'))), "")


def _links_sql(stem: str) -> str:
    return f"""array_to_string(list_transform(range((k - 1) * {CHILDREN} + 2, k * {CHILDREN} + 2), lambda c: '<a href="{stem}' || c || '">x</a>'), '')"""


def run_crawl(spark, sf_dir):
    """A crawl of all pages as one site that stops at its budget of half of them, and one that goes on from its table. Links that lead nowhere are tried, too."""
    path, k = fresh_path(spark, "crawl"), F.col("k")
    pages = _heap(spark, sf_dir, True).select(F.concat(F.lit(f"{SITE}/p/"), k.cast("string")).alias("url"), F.concat(_links(k, "/p/"), F.coalesce("html", F.lit(""))).alias("html"))
    pages = written(pages, "archive")
    archive, n = fetch.Archive(pages), pages.count()
    P.crawl_site(spark, [f"{SITE}/p/1"], C.DOMAIN, f"{path}/run=1", archive, budget=n // 2)
    first = spark.read.parquet(f"{path}/run=1")
    first.write.parquet(f"{path}/all")
    P.crawl_site(spark, [f"{SITE}/p/1"], C.DOMAIN, f"{path}/all", archive, budget=n, resume=True)
    found = spark.read.parquet(f"{path}/all")
    return found.join(first.select("url", F.lit(True).alias("f")), "url", "left").select("url", F.md5("html").alias("html_md5"), F.coalesce("f", F.lit(False)).alias("first_run"))


CRAWL_SQL = f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY page_id) AS k, COUNT(*) OVER () AS n FROM pages)
SELECT '{SITE}/p/' || k AS url, md5({_links_sql("/p/")} || COALESCE(html, '')) AS html_md5, k <= n // 2 AS first_run FROM p
"""


def run_category_crawl(spark, sf_dir):
    """Three crawls at once, each of a third of the pages, up to its own cap. Every page has a dead link first, which counts against the cap."""
    rows = _heap(spark, sf_dir, False)
    third = F.concat(F.lit("c"), ((F.col("k") - 1) % 3).cast("string"))
    rows = rows.select(third.alias("category"), F.floor((F.col("k") - 1) / 3).cast("long").alias("i"), "html").withColumn("k", F.col("i") + 1)
    stem = F.concat(F.lit("/"), "category", F.lit("/"))
    inside = F.regexp_replace(F.concat(F.lit('<a href="/@/gone'), F.col("k").cast("string"), F.lit('">x</a>'), _links(F.col("k"), "/@/")), "/@/", stem)
    pages = rows.select(F.concat(F.lit(SITE), stem, F.col("k").cast("string")).alias("url"), F.concat(inside, F.coalesce("html", F.lit(""))).alias("html"))
    plan = spark.createDataFrame([(c, [f"{SITE}/{c}/1"], cap) for c, cap in CAPS.items()], "category string, seeds array<string>, cap int")
    return crawl.crawl_categories(spark, plan, fetch.Archive(pages), C.DOMAIN).select("category", "url", F.md5("html").alias("html_md5"))


CATEGORY_CRAWL_SQL = f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS o FROM pages),
p AS (SELECT 'c' || (o % 3) AS category, o // 3 + 1 AS k, regexp_replace(COALESCE(html, ''), '<a ', '<b ', 'gi') AS html FROM o),
t AS (SELECT *, k + CASE WHEN k = 1 THEN 0 ELSE (k - 2) // {CHILDREN} + 1 END AS tried, CASE category WHEN 'c0' THEN 10 WHEN 'c1' THEN {CAPS["c1"]} ELSE {CAPS["c2"]} END AS cap FROM p)
SELECT category, '{SITE}/' || category || '/' || k AS url, md5(replace('<a href="/@/gone' || k || '">x</a>' || {_links_sql("/@/")}, '/@/', '/' || category || '/') || html) AS html_md5 FROM t WHERE tried <= cap
"""


def run_question_prompts(spark, sf_dir):
    """What a generator of questions is asked, for every page that is long enough."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", H.for_questions("html").alias("text")).where(F.char_length("text") >= generate.PAGE_CHARS)
    return pages.select("page_id", F.md5(generate.question_prompt(F.col("text"), F.col("url"), F.lit("names and years"), F.lit(3))).alias("prompt_md5"))


PROMPTS_SQL = f"""
WITH q AS ({C.QUESTION_TEXT_SQL})
SELECT page_id, md5('Write 3 questions that only this page answers, each on another fact, with short answers found in its text. Separate equal answers by |. Reply with one JSON object a line, with question, answer and url ('
                    || COALESCE(url, '') || ').' || chr(10) || 'names and years' || chr(10) || chr(10) || substr(text, 1, {generate.QUESTION_CHARS})) AS prompt_md5
FROM q JOIN pages USING (page_id)
"""


def _unsteady():
    """A generator for tests of retries: for prompt n the first model fails n % 7 times, by quota if n is odd, and the second one has an answer only to every fifth. Says how long was waited, too."""
    calls: dict[str, int] = {}
    waited: list[float] = []

    def first(prompt: str) -> str:
        calls[prompt] = calls.get(prompt, 0) + 1
        if calls[prompt] <= int(prompt) % 7:
            raise RuntimeError("429" if int(prompt) % 2 else "broken")
        return "first"

    def second(prompt: str) -> str:
        if int(prompt) % 5:
            raise RuntimeError("broken")
        return "second"

    tried = generate.with_retries([first, second], 5, generate.Rule(lambda n, _: 15 * (n + 1)), generate.Rule(lambda n, _: 3 * (n + 1), 3), "unknown", waited.append)

    def run(prompt: str) -> str:
        calls.clear()
        waited.clear()
        said = tried(prompt)
        return f"{said} after {int(sum(waited))}"

    return run


def run_retries(spark, sf_dir):
    """A model that fails for every event, by quota or otherwise, more or less often, and another one behind it."""
    prompts = C.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("prompt"))
    return generate.generated(prompts, "prompt", _unsteady()).select("prompt", "raw", "error")


RETRIES_SQL = """
WITH e AS (SELECT event_id AS i, event_id % 7 AS n, event_id % 2 = 1 AS quota FROM events),
w AS (SELECT i, CASE WHEN quota THEN n < 5 ELSE n < 3 END AS good, CASE WHEN quota THEN 15 * (LEAST(n, 5) * (LEAST(n, 5) + 1) // 2) ELSE 3 * (LEAST(n, 2) * (LEAST(n, 2) + 1) // 2) END AS waited FROM e)
SELECT i::VARCHAR AS prompt, NULL::VARCHAR AS error, CASE WHEN good THEN 'first after ' || waited WHEN i % 5 = 0 THEN 'second after ' || waited ELSE 'unknown after ' || (waited + 9) END AS raw FROM w
"""

QUERIES = {f.__name__: f for f in (run_jsonl_scan, run_chunk_corpus, run_answers, run_progress_log, run_merge, run_crawl, run_category_crawl, run_question_prompts, run_retries)}

SQL = {
    "run_jsonl_scan": SCAN_SQL, "run_chunk_corpus": CHUNK_CORPUS_SQL, "run_answers": ANSWERS_SQL, "run_progress_log": LOG_SQL, "run_merge": MERGE_SQL, "run_crawl": CRAWL_SQL, "run_category_crawl": CATEGORY_CRAWL_SQL,
    "run_question_prompts": PROMPTS_SQL, "run_retries": RETRIES_SQL,
}
