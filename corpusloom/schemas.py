"""Schemas of the records that pass between pipeline steps."""

from __future__ import annotations

MANIFEST = "url string, filename string, timestamp double"
SECTION = "struct<heading: string, text: string>"
PARSED = f"title string, text string, sections array<{SECTION}>"
DOCUMENT = "url string, title string, text string"
PROGRESS = "url string, title string, text string, text_original string, llm_cleaned boolean"
MERGED = "url string, text string"
CHUNK = "chunk_id bigint, url string, title string, section string, text string"
POSTING = "term string, chunk_id bigint, tf bigint"
QA = "question string, answer string, url string"
SQUAD = "version string, data array<struct<paragraphs: array<struct<qas: array<struct<id: string, answers: array<struct<text: string>>>>>>>>"
REPORT = "n bigint, em double, f1 double, recall double"
CATEGORY = "category string, seeds array<string>, cap int, n_q int, hint string"
MESSAGE = "struct<role: string, content: string>"
CHAT_REQUEST = f"model string, messages array<{MESSAGE}>, max_tokens int, temperature double"
