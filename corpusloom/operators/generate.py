"""Prompts, generators and what is made of their output.

A generator is any function from a prompt to a text. The default is a stub that repeats a line of its prompt: it is no model,
and stands in where none can be reached.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, answered_by, clean_answer, strip, tidy_alternatives, too_wordy
from ..storage import numbered

Generator = Callable[[str], str]
#: Models that answers may come from, the first by default.
MODELS = ("meta-llama/llama-3.1-8b-instruct", "meta-llama/llama-3-8b-instruct", "qwen/qwen3-8b", "qwen/qwen-2.5-7b-instruct", "allenai/olmo-3-7b-instruct", "mistralai/mistral-7b-instruct")
REWRITE_CHARS, QUESTION_CHARS, LEAST_CHARS, LEAST_REWRITE = 8000, 6000, 50, 30
PAGE_CHARS = 200
#: Prompts of a batch that are Python objects at one time.
SLICE = 64


def stub(prompt: str) -> str:
    """The first line of the first passage of a prompt, no more than ten words of it."""
    lines = [x for x in prompt.split("\n") if x.strip()]
    return " ".join(lines[2].split()[:10]) if len(lines) > 2 else UNKNOWN


def chat_model(endpoint: str, model: str = MODELS[0], system: str = "", max_tokens: int = 64, temperature: float = 0.0, timeout: float = 30.0, key_variable: str = "CHAT_API_KEY") -> Generator:
    """A chat-completion service as a generator; the key is read from the environment where it runs."""
    if model not in MODELS:
        raise ValueError(f"{model} is not one of {', '.join(MODELS)}")

    def generate(prompt: str) -> str:
        key = os.environ.get(key_variable, "").strip()
        if not key:
            raise ValueError(f"{key_variable} is not set")
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature}).encode()
        request = urllib.request.Request(endpoint, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                choices = json.load(r).get("choices") or []
            return choices[0]["message"]["content"].strip()
        except (OSError, ValueError, LookupError, AttributeError) as e:
            raise RuntimeError(f"no answer from the model: {e}") from e

    return generate


#: What marks an error of a service as one of quota.
QUOTA_MARKS = ("429", "RESOURCE_EXHAUSTED")


@dataclass(frozen=True)
class Rule:
    """For one kind of error: how long to wait after the n-th call, and how many in a row end the calls of a generator (0: any number)."""

    wait: Callable[[int, str], float]
    most: int = 0


def with_retries(generators: list[Generator], tries: int, quota: Rule, other: Rule, otherwise: str | None, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """Calls the generators in turn, each up to `tries` times, by the rules for the kinds of errors. `otherwise` is the result if all fail."""
    rules = {True: quota, False: other}

    def calls(generate: Generator, prompt: str) -> Iterator[str | Exception]:
        for _ in range(tries):
            try:
                yield generate(prompt).strip()
            except Exception as e:  # whatever a service raises
                yield e

    def run(prompt: str) -> str | None:
        for generate in generators:
            streak, kind = 0, None
            for n, said in enumerate(calls(generate, prompt)):
                if isinstance(said, str):
                    return said
                was, kind = kind, any(mark in str(said) for mark in QUOTA_MARKS)
                streak = streak + 1 if kind == was else 1
                if streak == rules[kind].most:
                    break
                sleep(rules[kind].wait(n, str(said)))
        return otherwise

    return run


def asked_or(delay_of: Callable[[str], float | None], wait: Callable[[int], float]) -> Callable[[int, str], float]:
    """The delay that a message asks for, or else wait(n)."""
    return lambda n, message: delay_of(message) or wait(n)


def answer_prompt(passages: Column, question: Column) -> Column:
    """Numbered passages (url, text) and a question."""
    blocks = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["url"], F.lit("")), F.lit("\n"), F.coalesce(p["text"], F.lit(""))))
    return F.concat(F.lit("Context:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def prompts(ranked: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, question, prompt): questions with the passages that were ranked for them."""
    found = ranked.join(chunks.select("chunk_id", "url", "text"), "chunk_id").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "text"))).alias("passages"))
    none = F.array().cast("array<struct<rank: int, url: string, text: string>>")
    rows = questions.join(found, "q", "left")
    return rows.select("q", "question", answer_prompt(F.coalesce("passages", none), F.col("question")).alias("prompt"))


def rewrite_prompt(title: Column, url: Column, text: Column) -> Column:
    """Asks for a clean version of a page's text, no facts added or lost."""
    ask = "Rewrite the text of this web page so that it reads well. Drop menus and repeated lines, mend broken sentences, mark headings with ##, and keep every name, number, date and address. Add nothing."
    return F.concat(F.lit(ask + "\n\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nAddress: "), F.coalesce(url, F.lit("")), F.lit("\n\n"), rewrite_input(text))


def question_prompt(text: Column, url: Column, hint: Column, n: Column) -> Column:
    """Asks for n questions on a page, as JSON lines with question, answer and url."""
    return F.concat(
        F.lit("Write "), n.cast("string"), F.lit(" questions that only this page answers, each on another fact, with short answers found in its text. Separate equal answers by |. Reply with one JSON object a line, with question, answer and url ("),
        F.coalesce(url, F.lit("")), F.lit(").\n"), F.coalesce(hint, F.lit("")), F.lit("\n\n"), F.substring(text, 1, QUESTION_CHARS),
    )


def generated(rows: DataFrame, prompt: str, generator: Callable[[str], str | None], partitions: int | None = None) -> DataFrame:
    """rows with `raw` and `error`: one call a row; a failure is an error, not the end of the job. partitions bounds calls at one time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", raw string, error string"

    def asked(p: str | None) -> tuple[str | None, str | None]:
        try:
            return generator(p), None
        except Exception as e:  # whatever a service raises
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all but a slice's prompts and answers stays in Arrow's memory, and a slice leaves before the next is asked for
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                said = [asked(p) for p in part.column(prompt).to_pylist()]
                made = [pa.array([x[i] for x in said], pa.string()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "raw", "error"])

    return (rows.repartition(partitions) if partitions else rows).mapInArrow(run, schema)


def answers(prompted: DataFrame, generator: Generator = stub, partitions: int | None = None) -> DataFrame:
    """(q, prediction, error): blank questions and failures are `unknown`."""
    blank = strip(F.col("question")) == ""
    asked = generated(prompted.where(~blank), "prompt", generator, partitions)
    done = asked.select("q", F.when(F.col("error").isNull(), clean_answer(F.col("raw"))).otherwise(F.lit(UNKNOWN)).alias("prediction"), "error")
    return done.unionByName(prompted.where(blank).select("q", F.lit(UNKNOWN).alias("prediction"), F.lit(None).cast("string").alias("error")))


def gate(text: Column) -> Column:
    """Whether a text is too short to be rewritten: it passes as it is."""
    return F.char_length(F.coalesce(text, F.lit(""))) < LEAST_CHARS


def rewrite_input(text: Column) -> Column:
    """What of a text is put into a prompt."""
    return F.substring(F.coalesce(text, F.lit("")), 1, REWRITE_CHARS)


def rewritten(docs: DataFrame, generator: Callable[[str], str | None], partitions: int | None = None) -> DataFrame:
    """(url, title, text, text_original, llm_cleaned) of (url, title, text). Short texts pass; a rewrite of 30 characters or fewer is refused."""
    rows = docs.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    passes = gate(F.col("text"))
    asked = generated(rows.where(~passes).withColumn("prompt", rewrite_prompt(F.col("title"), F.col("url"), F.col("text"))), "prompt", generator, partitions)
    good = F.coalesce(F.char_length("raw") > LEAST_REWRITE, F.lit(False))
    none = F.lit(None).cast("string")
    done = asked.select("url", "title", F.when(good, F.col("raw")).otherwise(F.col("text")).alias("text"), F.when(good, F.col("text")).otherwise(none).alias("text_original"), good.alias("llm_cleaned"))
    return rows.where(passes).select("url", "title", "text", none.alias("text_original"), F.lit(False).alias("llm_cleaned")).unionByName(done)


def parsed_pairs(rows: DataFrame, raw: str = "raw", url: str = "url") -> DataFrame:
    """(url, question, answer) from generated lines: those that are JSON objects with both keys; others, fences included, are skipped."""
    lines = rows.select(F.col(url).alias("url"), F.posexplode(F.split(raw, "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    object_ = F.from_json("line", "map<string, string>")
    found = lines.where(F.startswith("line", F.lit("{"))).select("url", "line_no", object_.alias("o"))
    has = F.map_contains_key("o", F.lit("question")) & F.map_contains_key("o", F.lit("answer"))
    return found.where(F.col("o").isNotNull() & has).select("url", "line_no", F.col("o")["question"].alias("question"), F.col("o")["answer"].alias("answer"))


def validated(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with tidy answers: not empty, no part over ten words, and found in the page where its text is known."""
    rows = pairs.withColumn("answer", tidy_alternatives(F.col("answer"))).where("answer <> ''").where(~too_wordy(F.col("answer")))
    rows = rows.join(texts.select("url", F.col("text").alias("_text")), "url", "left")
    return rows.where(F.col("_text").isNull() | answered_by(F.col("answer"), F.col("_text"))).drop("_text")


def planned(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """rows with their category's cap, n_q and hint, or 10, 2 and an empty one."""
    dim = categories.select("category", F.col("cap").alias("_cap"), F.col("n_q").alias("_n"), F.col("hint").alias("_hint"))
    out = rows.join(dim, "category", "left")
    return out.withColumns({"cap": F.coalesce("_cap", F.lit(10)), "n_q": F.coalesce("_n", F.lit(2)), "hint": F.coalesce("_hint", F.lit(""))}).drop("_cap", "_n", "_hint")


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows in an order that depends on key and seed only."""
    return rows.orderBy(_draw(key, seed), key)


def with_places(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows with their place in that order, from 1. Ranges of the order are counted, so that no task ranks all rows."""
    return numbered(rows.withColumn("_draw", _draw(key, seed)), ["_draw", key], "place").withColumn("place", F.col("place") + 1).drop("_draw")


def sampled(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About `share` of the rows, the same ones in every run."""
    return rows.where(F.conv(F.substring(_draw(key, seed), 1, 13), 16, 10).cast("long") < share * (1 << 52))
