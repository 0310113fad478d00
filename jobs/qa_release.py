"""A release of question and answer pairs from conversations, to tune and to test a retrieval system with.

    python -m jobs.qa_release --config jobs/qa_release.json

Each user's turn is a question, the assistant's next turn its answer. Every question ends in one of five ways, and is on record with it:

    unanswered   there is no such turn
    blank        the question has no word
    unknown      nothing is left of the answer when it has been cleaned
    repeated     the question is like an earlier one that is kept
    kept         it is in the release, in the split that its conversation belongs to

Splits are drawn by conversation, from a hash of seed and id, so that no conversation is in two of them, and a later release over more
conversations leaves the old ones where they were. Written with Spark, a folder for each release:

    pairs/release=R/split=…      question, answer
    dropped/release=R/reason=…   what was left out
    report/release=R             counts by outcome and split

A release is written whole; running it again replaces it by the same rows, and leaves other releases alone.

Of rows that repeat in conversation, turn and role, the one with the smallest text counts; rows without one of these are unanswered questions if
a user's, else nothing. Texts of any length are compared whole.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import merge, neardup
from corpusloom.plans.catalogue import LETTER_FORM
from corpusloom.storage import fresh_path, removed, shuffled_side, written

from . import common

log = logging.getLogger("jobs.qa_release")

SPLITS = (("train", 0.8), ("dev", 0.1), ("test", 0.1))
PAIRS = "conv_id {id}, turn {turn}, question string, answer string, release string, split string"
DROPPED = "conv_id {id}, turn {turn}, question string, release string, reason string"
REPORT = "outcome string, split string, pairs long, release string"


def questions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, reply) of all user's turns; reply is null without one. An equality join: a conversation of any length is dealt out by turn."""
    one = merge.first_wins(turns.select("conv_id", "turn", "role", "text", F.coalesce("text", F.lit("")).alias("_order")), "conv_id", "turn", "role", order="_order")
    asked = one.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = one.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast(turns.schema["turn"].dataType).alias("turn"), F.coalesce("text", F.lit("")).alias("reply"))
    return asked.join(shuffled_side(replies), ["conv_id", "turn"], "left")


def judged(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with ord, answer and outcome, but for repeated questions, which are still `kept`."""
    answer = T.clean_answer(F.col("reply"))
    blank = F.size(T.words(T.question_form(F.coalesce("question", F.lit(""))))) == 0
    outcome = F.when(F.col("reply").isNull(), "unanswered").when(blank, "blank").when(F.lower(answer) == T.UNKNOWN, "unknown").otherwise("kept")
    return rows.select(F.struct("conv_id", "turn").alias("ord"), "conv_id", "turn", "question", answer.alias("answer"), outcome.alias("outcome"))


def split_of(key: str, splits, seed: int):
    """The split that a key's hash falls into."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    bounds, below = F.lit(splits[-1][0]), [sum(share for _, share in splits[: i + 1]) for i in range(len(splits))]
    for (name, _), bound in reversed(list(zip(splits[:-1], below))):
        bounds = F.when(draw < bound * (1 << 52), name).otherwise(bounds)
    return bounds


def run(spark: SparkSession, source: str, out: str, release: str, seed: int = 7, threshold: float = neardup.THRESHOLD, splits=SPLITS) -> DataFrame:
    """Writes the release, and returns its report."""
    if abs(sum(share for _, share in splits) - 1) > 1e-9:
        raise ValueError("the splits' shares don't add up to 1")
    turns = spark.read.parquet(source)
    log.info("reading %s", source)
    rows = written(judged(questions(turns), threshold), "judged")
    good = rows.where("outcome = 'kept'")
    kept = written(neardup.kept(good.select("ord", "question"), threshold).select("ord"), "kept").withColumn("_kept", F.lit(True))
    repeated = (F.col("outcome") == "kept") & F.col("_kept").isNull()
    done = rows.join(shuffled_side(kept), "ord", "left").withColumn("outcome", F.when(repeated, "repeated").otherwise(F.col("outcome"))).withColumn("split", split_of("conv_id", splits, seed))
    # the largest split may be most of the rows: a rebalanced one is written by as many tasks as it asks for
    pairs = done.where("outcome = 'kept'").select("conv_id", "turn", "question", "answer", "split").hint("rebalance", "split")
    pairs.write.mode("overwrite").partitionBy("split").json(f"{out}/pairs/release={release}")
    dropped = done.where("outcome <> 'kept'").select("conv_id", "turn", "question", F.col("outcome").alias("reason")).hint("rebalance", "reason")
    dropped.write.mode("overwrite").partitionBy("reason").json(f"{out}/dropped/release={release}")
    kinds = _kinds(turns)
    counts = _read(spark, out, "pairs", PAIRS, kinds, release).groupBy(F.lit("kept").alias("outcome"), "split").agg(F.count("*").alias("pairs"))
    counts = counts.unionByName(_read(spark, out, "dropped", DROPPED, kinds, release).groupBy(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("split")).agg(F.count("*").alias("pairs")))
    counts.coalesce(1).write.mode("overwrite").json(f"{out}/report/release={release}")
    removed(rows)
    removed(kept)
    report = spark.read.schema(REPORT).option("basePath", f"{out}/report").json(f"{out}/report/release={release}")
    for r in report.collect():  # a row for each outcome and split
        log.info("release %s: %s %s %d", release, r.outcome, r.split or "", r.pairs)
    return report


def _kinds(turns: DataFrame) -> dict[str, str]:
    return {"id": turns.schema["conv_id"].dataType.simpleString(), "turn": turns.schema["turn"].dataType.simpleString()}


def _read(spark: SparkSession, out: str, table: str, schema: str, kinds: dict[str, str], release: str) -> DataFrame:
    return spark.read.schema(schema.format(**kinds)).option("basePath", f"{out}/{table}").json(f"{out}/{table}/release={release}")


def job2_qa_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release made twice into a new folder: every question with its outcome, and those that are kept with their answer."""
    source, where = f"{sf_dir}/conversations.parquet", fresh_path(spark, "job2")
    for _ in range(2):
        run(spark, source, where, "all")
    kinds = _kinds(spark.read.parquet(source))
    pairs = _read(spark, where, "pairs", PAIRS, kinds, "all").select("conv_id", "turn", F.lit("kept").alias("outcome"), "split", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))
    dropped = _read(spark, where, "dropped", DROPPED, kinds, "all").select("conv_id", "turn", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("split"), F.md5("question").alias("question_md5"), F.lit(None).cast("string").alias("answer_md5"))
    return pairs.unionByName(dropped)


def _clean_sql(x: str) -> str:
    """The answer's cleaning, step by step, as nested tables: line breaks, lead-ins, quotes."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    steps = f"SELECT *, trim(replace({x}, chr(10), ' '), {space}) AS s0 FROM j"
    for n, prefix in enumerate(T.ANSWER_PREFIXES):
        rest = f"trim(ltrim(trim(substr(s{n}, {len(prefix) + 1}), {space}), ':'), {space})"
        steps = f"SELECT *, CASE WHEN lower(s{n}) LIKE '{prefix.lower()}%' THEN {rest} ELSE s{n} END AS s{n + 1} FROM ({steps})"
    bare = f"""trim(trim(trim(s{len(T.ANSWER_PREFIXES)}, '"'), ''''), {space})"""
    return f"SELECT *, CASE WHEN {bare} = '' THEN '{T.UNKNOWN}' ELSE {bare} END AS answer FROM ({steps})"


JOB2_SQL = f"""
WITH RECURSIVE one AS (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY COALESCE(text, '')) = 1),
j AS (SELECT u.conv_id, u.turn, u.text AS question, a.conv_id IS NOT NULL AS answered, COALESCE(a.text, '') AS reply FROM (SELECT * FROM one WHERE role = 'user') u LEFT JOIN (SELECT * FROM one WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
c AS ({_clean_sql("reply")}),
w AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all({LETTER_FORM.format("question")}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM c),
o AS (SELECT *, CASE WHEN NOT answered THEN 'unanswered' WHEN COALESCE(len(w), 0) = 0 THEN 'blank' WHEN lower(answer) = 'unknown' THEN 'unknown' ELSE 'kept' END AS outcome FROM w),
g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS k FROM o WHERE outcome = 'kept'),
dup AS MATERIALIZED (SELECT b.k AS k, list(a.k) AS earlier FROM g a JOIN g b ON a.k < b.k WHERE len(list_intersect(a.w, b.w))::DOUBLE / LEAST(len(a.w), len(b.w)) > {neardup.THRESHOLD} GROUP BY b.k),
n AS MATERIALIZED (SELECT g.k, earlier FROM g LEFT JOIN dup ON dup.k = g.k),
r(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN n.earlier IS NOT NULL AND list_has_any(r.kept, n.earlier) THEN r.kept ELSE list_append(r.kept, n.k) END FROM r JOIN n ON n.k = r.k + 1),
stay AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1)),
f AS (SELECT o.conv_id, o.turn, o.question, o.answer, CASE WHEN o.outcome <> 'kept' THEN o.outcome WHEN s.k IS NULL THEN 'repeated' ELSE 'kept' END AS outcome,
             ('0x' || substr(md5('7:' || COALESCE(o.conv_id::VARCHAR, '')), 1, 13))::BIGINT AS draw
      FROM o LEFT JOIN g ON g.conv_id = o.conv_id AND g.turn = o.turn LEFT JOIN stay s ON s.k = g.k)
SELECT conv_id, turn, outcome, CASE WHEN outcome = 'kept' THEN CASE WHEN draw < {0.8 * 2**52!r} THEN 'train' WHEN draw < {0.9 * 2**52!r} THEN 'dev' ELSE 'test' END END AS split,
       md5(question) AS question_md5, CASE WHEN outcome = 'kept' THEN md5(answer) END AS answer_md5 FROM f
"""


if __name__ == "__main__":
    common.main("qa_release", run, ("source", "out", "release"))
