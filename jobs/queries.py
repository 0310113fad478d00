"""The jobs as registered queries, and DuckDB SQL for them."""

from __future__ import annotations

from . import passage_feed, qa_release

QUERIES = {"job1_passage_feed": passage_feed.job1_passage_feed, "job2_qa_release": qa_release.job2_qa_release}
SQL = {"job1_passage_feed": passage_feed.JOB1_SQL, "job2_qa_release": qa_release.JOB2_SQL}
