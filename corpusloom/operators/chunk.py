"""Documents to passages: sections by heading lines, then sliding windows of words. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, words

SIZE, OVERLAP = 400, 50
#: Windows of fewer words are dropped, and documents of fewer characters.
LEAST_WORDS, LEAST_CHARS = 30, 50


def check_sizes(size: int, overlap: int) -> None:
    if size < LEAST_WORDS:
        raise ValueError(f"windows of {size} words are all dropped; the least is {LEAST_WORDS}")
    if overlap < 0:
        raise ValueError("overlap is negative")


def windows(text_words: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` words at steps of size - overlap (1 at least); those with fewer than LEAST_WORDS words are left out.

    Lengths don't grow from one window to the next, so leaving out short ones equals stopping at the first.
    """
    step = max(size - overlap, 1)
    last = F.size(text_words) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.slice(text_words, i + 1, F.lit(size))), lambda w: F.size(w) >= LEAST_WORDS)


def sections(text: Column) -> Column:
    """Array of (heading, text): lines under each line that begins with two hashes and a space; blank lines and empty sections are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    empty = F.array().cast("array<struct<heading: string, text: string>>")
    # a later line joins the last section; array and text build up within the row
    start = F.struct(empty.alias("done"), F.lit("").alias("heading"), F.lit("").alias("body"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["body"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["heading"].alias("heading"), acc["body"].alias("text")))))

    def step(acc: Column, line: Column) -> Column:
        is_heading = F.startswith(line, F.lit("## "))
        return F.when(is_heading, F.struct(flushed(acc).alias("done"), strip(F.substring(line, 4, 1 << 30)).alias("heading"), F.lit("").alias("body"))).otherwise(
            F.struct(acc["done"].alias("done"), acc["heading"].alias("heading"), F.when(acc["body"] == "", line).otherwise(F.concat(acc["body"], F.lit("\n"), line)).alias("body"))
        )

    return F.aggregate(lines, start, step, flushed)


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, sectioned: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, url, title, section_idx, part_idx, section, text) of (doc_id, url, title, text), and further columns to keep.

    With more than one section each is a passage, else the whole text is; those of more than `size` words are cut to windows.
    """
    check_sizes(size, overlap)
    title, own = F.coalesce("title", F.lit("")), ("doc_id", "url", "title", *keep)
    # outer explodes: inner ones would have the arrays computed twice, once for an inferred filter on their size
    found = sectioned if sectioned is not None else sections(F.col("text"))
    rows = docs.where(F.char_length("text") >= LEAST_CHARS).select("doc_id", "url", title.alias("title"), *keep, F.col("text").alias("body"), found.alias("sections"))
    whole = F.array(F.struct(F.lit("").alias("heading"), F.col("body").alias("text")))
    rows = rows.select(*own, F.posexplode_outer(F.when(F.size("sections") > 1, F.col("sections")).otherwise(whole)).alias("section_idx", "s"))
    rows = rows.select(*own, "section_idx", F.col("s.heading").alias("heading"), F.col("s.text").alias("body"), words(F.col("s.text")).alias("w"))
    cut = F.size("w") > size
    parts = F.when(cut, F.transform(windows(F.col("w"), size, overlap), lambda x: F.array_join(x, " "))).otherwise(F.array("body"))
    rows = rows.select(*own, "section_idx", "heading", cut.alias("cut"), F.posexplode_outer(parts).alias("part_idx", "part")).where("part is not null")
    number = F.concat(F.lit("part "), (F.col("part_idx") + 1).cast("string"))
    section = F.when(F.col("cut") & (F.col("heading") != ""), F.concat("heading", F.lit(" ("), number, F.lit(")"))).when(F.col("cut"), number).otherwise(F.col("heading"))
    prefix = F.concat("title", F.when(F.col("heading") != "", F.concat(F.lit(" > "), "heading")).otherwise(F.lit("")), F.when(F.col("cut"), F.concat(F.lit(" ("), number, F.lit(")"))).otherwise(F.lit("")), F.lit("\n"))
    return rows.select("doc_id", "url", "title", "section_idx", "part_idx", section.alias("section"), F.concat(prefix, "part").alias("text"), *keep)
