from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate as E


def value(spark, column, **cells):
    types = {bool: "boolean", int: "int", float: "double", list: "array<string>"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("form", "given", "want"),
    [
        (T.tokens, "CS-61A a_b é x", ["cs", "61a", "a_b", "x"]),
        (T.answer_form, "The U.S. rank!", "the us rank"),
        (T.answer_form, None, ""),
        (T.answer_form, " a\x1cb ", "a b"),
        (T.squad_form, "The U.S. rank!", "us rank"),
        (T.question_form, "résumé", "re sume"),
        (T.question_form, "A, b_C!", "a b_c"),
        (T.compatible, "ﬁne　 ①", "fine 1"),
        (T.words, " a b\x1d c ", ["a", "b", "c"]),
        (T.alternatives, "a | b|", ["a", "b", ""]),
        (T.tidy_alternatives, " a | |b ", "a|b"),
        (T.too_wordy, "x|1 2 3 4 5 6 7 8 9 10", False),
        (T.too_wordy, "x|1 2 3 4 5 6 7 8 9 10 11", True),
        (T.clean_answer, 'Answer: The answer is: "X"', "X"),
        (T.clean_answer, "The answer is Answer: X", "Answer: X"),
        (T.clean_answer, "", "unknown"),
        (T.clean_answer, None, "unknown"),
        (T.clean_answer, "\"''\"", "unknown"),
        (T.clean_answer, "a\nb", "a b"),
        (T.retry_delay, "please Retry in 3.5s", 5.5),
        (T.retry_delay, '"retryDelay": "500s"', 120.0),
        (T.retry_delay, "busy", None),
    ],
)
def test_forms(spark, form, given, want):
    assert value(spark, form(F.col("x")), x=given) == want


@pytest.mark.parametrize(
    ("p", "r", "f1", "squad"), [("", "", 1.0, 0.0), ("a b", "", 0.0, 0.0), ("", "x", 0.0, 0.0), ("x x y", "x y y", 2 / 3, 2 / 3), ("the cat", "cat", 2 / 3, 1.0), ("q", "z", 0.0, 0.0)]
)
def test_f1(spark, p, r, f1, squad):
    assert value(spark, E.token_f1(F.col("p"), F.col("r")), p=p, r=r) == pytest.approx(f1)
    assert value(spark, E.squad_f1(F.col("p"), F.col("r")), p=p, r=r) == pytest.approx(squad)


def test_empty_alternative_matches_empty_prediction(spark):
    p = spark.createDataFrame([(0, ""), (1, "b"), (2, "c")], "pos long, prediction string")
    g = spark.createDataFrame([(i, a) for i, a in enumerate(["x|", "a|B!", "z", "q", "r"])], "pos long, answer string")
    row = E.report(E.scored(p, g)).first()
    assert (row.n, row.em, row.f1) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert E.report(E.scored(p.limit(0), g)).first().n == 0


def test_squad_counts_missing_predictions(spark):
    q = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", [])], "id string, answers array<string>")
    p = spark.createDataFrame([("a", "x"), ("c", "x")], "id string, prediction string")
    row = E.squad_report(q, p).first()
    assert (row.total, row.exact_match) == (3, pytest.approx(100 / 3))


def test_ratios(spark):
    assert value(spark, T.overlap_ratio(F.col("a"), F.col("b")), a=["x", "y"], b=["x", "y", "z"]) == 1.0
    assert value(spark, T.overlap_ratio(F.col("a"), F.col("b")), a=[], b=["x"]) is None
    assert value(spark, T.answered_by(F.col("a"), F.col("p")), a="one|two|three", p="only two here") is True
    assert value(spark, T.answered_by(F.col("a"), F.col("p")), a="one", p="only two here") is False
    assert value(spark, T.answered_by(F.col("a"), F.col("p")), a="CAFÉ|x|y|z", p="at the café, x") is True
    assert value(spark, T.answered_by(F.col("a"), F.col("p")), a="?!", p="anything") is True
    assert value(spark, T.contains_any(F.col("t"), F.col("a")), t="abc", a=["", "bc"]) is True
