"""Text functions. All are Column expressions, but for Unicode normal forms, which Spark SQL lacks and Arrow UDFs do."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A whitespace character as Python's str methods see it; Java's Unicode \s leaves out the four separators.
SPACE = r"[\s\x1c-\x1f]"
#: Fixed value: the 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What answers are cleaned of, in this order.
ANSWER_PREFIXES = ("Answer:", "The answer is", "Based on the context,")
UNKNOWN = "unknown"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """One row for each element. An inner explode would make Spark infer a filter on the array's size, and so compute the array twice."""
    return rows.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def strip(c: Column) -> Column:
    """Without whitespace at both ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def words(c: Column) -> Column:
    """Words between whitespace."""
    return F.filter(F.split(c, f"(?U){SPACE}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def counted(array: Column) -> Column:
    """Array of (term, n): each different element and how often it occurs, in order of elements; counted in the row, in one pass after a sort."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))

    return let(F.sort_array(array), runs)


def answer_form(c: Column) -> Column:
    """Form in which answers are compared: lower case, without ASCII punctuation, single spaces. Null is empty."""
    return collapse(F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, ""))


def squad_form(c: Column) -> Column:
    """As answer_form, and without articles."""
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.lower()))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _word_form(c: Column) -> Column:
    # combining marks aren't word characters here: they become spaces
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\x1c-\x1f]", " "))


def question_form(c: Column) -> Column:
    """Form in which questions are compared: decomposed, lower case, what isn't a letter, digit or underscore a space."""
    return _word_form(_nfkd(c))


def ascii_question_form(c: Column) -> Column:
    """question_form of ASCII text, without Python."""
    return collapse(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "))


def compatible(c: Column) -> Column:
    """NFKC with collapsed whitespace."""
    return collapse(_nfkc(c))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags of strings: both are sorted together, and each word's runs are counted in one pass."""
    tagged = lambda bag, n_a, n_b: F.transform(bag, lambda w: F.struct(w.alias("w"), F.lit(n_a).alias("a"), F.lit(n_b).alias("b")))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))
    shared = lambda x: x["n"] + F.least(x["a"], x["b"])

    def step(x: Column, y: Column) -> Column:
        more = F.struct(y["w"].alias("w"), (x["a"] + y["a"]).alias("a"), (x["b"] + y["b"]).alias("b"), x["n"].alias("n"))
        return F.when(x["w"] == y["w"], more).otherwise(F.struct(y["w"].alias("w"), y["a"].alias("a"), y["b"].alias("b"), shared(x).alias("n")))

    return F.aggregate(F.array_sort(F.concat(tagged(a, 1, 0), tagged(b, 0, 1))), start, step, shared)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared elements of two sets, by the size of the smaller; null if one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def alternatives(c: Column) -> Column:
    """Answers between bars, stripped; empty ones stay."""
    return F.transform(F.split(c, r"\|"), strip)


def tidy_alternatives(c: Column) -> Column:
    """The same, without empty ones, as one string."""
    return F.array_join(F.filter(alternatives(c), lambda x: x != ""), "|")


def too_wordy(c: Column, most: int = 10) -> Column:
    """Whether an alternative has more words than `most`."""
    return F.exists(alternatives(c), lambda x: F.size(words(x)) > most)


def answered_by(answer: Column, page: Column) -> Column:
    """Whether at least half (rounded down, but one) of the non-empty alternatives occur in the page, in question form."""
    given = F.filter(F.split(_nfkd(answer), r"\|"), lambda x: strip(x) != "")
    return let(F.struct(F.transform(given, _word_form).alias("parts"), _word_form(_nfkd(page)).alias("text")), _half_found)


def _half_found(x: Column) -> Column:
    hits = F.size(F.filter(x["parts"], lambda part: F.contains(x["text"], part)))
    return hits >= F.greatest(F.lit(1), F.floor(F.size(x["parts"]) / 2))


def contains_any(text: Column, answers: Column) -> Column:
    """Whether a non-empty answer occurs in the text; both are in answer form."""
    return F.exists(answers, lambda a: (a != "") & F.contains(text, a))


def clean_answer(c: Column) -> Column:
    """A generated answer without line breaks, lead-ins and quotes; `unknown` if nothing is left."""
    out = strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))
    for prefix in ANSWER_PREFIXES:
        rest = strip(F.ltrim(strip(F.substring(out, len(prefix) + 1, 1 << 30)), F.lit(":")))
        out = F.when(F.startswith(F.lower(out), F.lit(prefix.lower())), rest).otherwise(out)
    out = strip(F.btrim(F.btrim(out, F.lit('"')), F.lit("'")))
    return F.when(out == "", F.lit(UNKNOWN)).otherwise(out)


#: How services say when to call again.
RETRY_FORMS = (r"(?i)retry in ([\d.]+)s", r"retryDelay.*?(\d+)s")


def retry_delay(message: Column, most: float = 120.0) -> Column:
    """Seconds that a quota error asks to wait, and two more, no more than `most`; null if it names none."""
    seconds = F.coalesce(*[F.nullif(F.regexp_extract(message, form, 1), F.lit("")).try_cast("double") for form in RETRY_FORMS])
    return F.when(seconds.isNotNull(), F.least(seconds + 2, F.lit(most)))
