"""Scoring of answers: exact match, token F1, recall at k, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alternatives, answer_form, bag_overlap, contains_any, let, squad_form, words


def _f1(prediction: Column, reference: Column, both_empty: float) -> Column:
    def of(bags: Column) -> Column:
        p, r = bags["p"], bags["r"]
        return let(bag_overlap(p, r).cast("double"), lambda same: score(same, F.size(p), F.size(r)))

    def score(same: Column, n_p: Column, n_r: Column) -> Column:
        precision, recall = F.try_divide(same, n_p), F.try_divide(same, n_r)
        f1 = F.try_divide(2 * precision * recall, precision + recall)
        return F.when((n_p == 0) & (n_r == 0), F.lit(both_empty)).otherwise(F.coalesce(f1, F.lit(0.0)))

    return let(F.struct(words(prediction).alias("p"), words(reference).alias("r")), of)


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the bags of words in answer form; 1 if both are empty, 0 if one is."""
    return _f1(answer_form(prediction), answer_form(reference), 1.0)


def exact_match(prediction: Column, reference: Column) -> Column:
    return (answer_form(prediction) == answer_form(reference)).cast("double")


def squad_f1(prediction: Column, reference: Column) -> Column:
    """F1 without articles; 0 if both are empty."""
    return _f1(squad_form(prediction), squad_form(reference), 0.0)


def squad_match(prediction: Column, reference: Column) -> Column:
    return squad_form(prediction) == squad_form(reference)


def best_over(metric, prediction: Column, answers: Column) -> Column:
    """The best of a metric over alternatives."""
    return F.array_max(F.transform(answers, lambda a: metric(prediction, a)))


def scored(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(pos, em, f1) of positions that both (pos, prediction) and (pos, answer) have."""
    answers = alternatives(F.col("answer"))
    rows = predictions.join(gold, "pos")
    return rows.select("pos", best_over(exact_match, F.col("prediction"), answers).alias("em"), best_over(token_f1, F.col("prediction"), answers).alias("f1"))


def report(scores: DataFrame) -> DataFrame:
    """(n, em, f1): one row; means are null without rows."""
    return scores.agg(F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("f1").alias("f1"))


def squad_report(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(exact_match, f1, total) in percent of (id, answers) and (id, prediction); a missing prediction counts as 0."""
    rows = questions.join(predictions, "id", "left")
    none = F.lit(0.0)
    em = F.coalesce(F.array_max(F.transform("answers", lambda a: squad_match(F.col("prediction"), a).cast("double"))), none)
    f1 = F.coalesce(F.array_max(F.transform("answers", lambda a: squad_f1(F.col("prediction"), a))), none)
    known = F.col("prediction").isNotNull()
    rows = rows.select(F.when(known, em).otherwise(none).alias("em"), F.when(known, f1).otherwise(none).alias("f1"))
    return rows.agg((100 * F.avg("em")).alias("exact_match"), (100 * F.avg("f1")).alias("f1"), F.count("*").alias("total"))


def hits(ranked: DataFrame, chunks: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(q, hit): whether the joined texts of the k best chunks hold an answer; (q, answers) asks."""
    texts = ranked.where(F.col("rank") <= k).join(chunks.select("chunk_id", "text"), "chunk_id")
    joined = texts.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("t"))
    text = answer_form(F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), " "))
    rows = gold.join(joined.select("q", text.alias("text")), "q", "left")
    found = contains_any(F.coalesce("text", F.lit("")), F.transform("answers", answer_form))
    return rows.select("q", F.coalesce(found, F.lit(False)).alias("hit"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(matched, total, rate) of two annotators."""
    same = F.col(a) == F.col(b)
    return rows.agg(F.count_if(same).alias("matched"), F.count("*").alias("total"), F.avg(same.cast("double")).alias("rate"))


def breakdown(labels: DataFrame, column: str) -> DataFrame:
    """(column, n, share) by label."""
    n = labels.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n").cast("double") / F.col("total")).alias("share"))
