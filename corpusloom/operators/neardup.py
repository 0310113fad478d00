"""Greedy removal of questions like earlier ones.

Questions are compared by the overlap of their word sets, by the size of the smaller. In order, a question is dropped if the overlap with
one that is kept exceeds the threshold. Candidate pairs share a word: of the word sets' rarest words, as many as a pair beyond the
threshold must share one of. Most candidates share little else, and they grow with the square of the rows: where two sets meet at a
word, their signatures tell how many words the smaller lacks at least, so that only pairs that may pass are shuffled and get their word
sets. Every join is shuffled: none of its sides passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_form, words
from ..storage import removed, shuffled_side, written

THRESHOLD = 0.80
#: Longs of a word set's signature: 256 bits, of which some 30 words leave nine in ten unset.
LONGS = 4


def word_sets(rows: DataFrame, form=question_form, text: str = "question") -> DataFrame:
    """(ord, w): the sorted words of each row that has any."""
    return rows.select("ord", F.array_sort(F.array_distinct(words(form(F.col(text))))).alias("w")).where(F.size("w") > 0)


def pairs(rows: DataFrame, threshold: float = THRESHOLD, form=question_form, text: str = "question") -> DataFrame:
    """(ord_a, ord_b, ratio) with ord_a < ord_b and an overlap above the threshold."""
    return alike(word_sets(rows, form, text), threshold)


def links(rows: DataFrame, threshold: float = THRESHOLD, form=question_form, text: str = "question") -> DataFrame:
    """(ord, class_id, links): one row each. Rows of one word set are a class, named by its first; links counts the other rows with an overlap above the threshold.

    Only the first ones of classes are compared, and their classes' sizes added up, so copies are never expanded to pairs. Rows without words are classes of their own.
    """
    sets = written(word_sets(rows, form, text), "sets")
    classes = written(sets.groupBy("w").agg(F.min("ord").alias("ord"), F.count("*").alias("n")), "classes")
    near = alike(classes.select("ord", "w"), threshold).select("ord_a", "ord_b")
    near = near.unionByName(near.select(F.col("ord_b").alias("ord_a"), F.col("ord_a").alias("ord_b")))
    sizes = near.join(shuffled_side(classes.select(F.col("ord").alias("ord_b"), "n")), "ord_b").groupBy(F.col("ord_a").alias("class_id")).agg(F.sum("n").alias("near"))
    totals = classes.select("w", F.col("ord").alias("class_id"), "n").join(shuffled_side(sizes), "class_id", "left")
    found = sets.join(shuffled_side(totals), "w").select("ord", "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    wordless = rows.select("ord").join(shuffled_side(sets.select("ord")), "ord", "left_anti").select("ord", F.col("ord").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(wordless)


def signature(w: Column) -> list[Column]:
    """LONGS longs with a bit for each word; what is set in one set's and not in another's is of words that the other lacks."""
    zero, one, bit = F.lit(0).cast("long"), F.lit(1).cast("long"), lambda x: F.pmod(F.xxhash64(x), F.lit(64 * LONGS)).cast("int")

    def part(i: int) -> Column:
        within = lambda x: (bit(x) >= 64 * i) & (bit(x) < 64 * (i + 1))
        return F.aggregate(w, zero, lambda found, x: F.when(within(x), found.bitwiseOR(F.call_function("shiftleft", one, bit(x) - 64 * i))).otherwise(found))

    return [part(i) for i in range(LONGS)]


def alike(sets: DataFrame, threshold: float) -> DataFrame:
    """The same of word sets.

    Overlap above t of the smaller set, of size m, leaves out fewer than (1 - t) m of its words. So among any
    floor((1 - t) m) + 1 words of it one is shared: sets are indexed whole, and probed by that many of their rarest words.
    """
    df = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    each = sets.select("ord", F.size("w").alias("m"), F.explode("w").alias("word"))
    rare = each.join(shuffled_side(df), "word").groupBy("ord", "m").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by"))
    few = F.slice("by", 1, F.floor(F.lit(1 - threshold) * F.col("m") + 1e-9).cast("int") + 1)
    marks = [f"s{i}" for i in range(LONGS)]
    signed = sets.select("ord", F.size("w").alias("m"), "w", *[x.alias(c) for x, c in zip(signature(F.col("w")), marks)])
    of = lambda x: [F.col("ord").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ["m", *marks]]]
    probes = rare.join(shuffled_side(signed.drop("w")), ["ord", "m"]).select(*of("a"), F.explode(F.transform(few, lambda x: x["word"])).alias("word"))
    index = signed.select(*of("b"), F.explode("w").alias("word"))
    lacks = reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseAND(F.bitwise_not(F.col(f"{c}_b")))) for c in marks])
    near = index.join(shuffled_side(probes), "word").where("a <> b and m_a < m_b or m_a = m_b and a < b").where((F.col("m_a") - lacks) / F.col("m_a") > threshold)
    # a is the smaller set, which is what travels to the other; pairs are dealt out once to be distinct and to meet it
    found = near.select("a", "b").repartition("a").distinct()
    left, right = (sets.select(F.col("ord").alias(x), F.col("w").alias(f"w_{x}")) for x in "ab")
    ratio = F.size(F.array_intersect("w_a", "w_b")) / F.least(F.size("w_a"), F.size("w_b"))
    both = found.join(shuffled_side(left), "a").join(shuffled_side(right), "b")
    return both.select(F.least("a", "b").alias("ord_a"), F.greatest("a", "b").alias("ord_b"), ratio.alias("ratio")).where(F.col("ratio") > threshold)


def kept(rows: DataFrame, threshold: float = THRESHOLD, form=question_form, text: str = "question") -> DataFrame:
    """rows that the greedy pass keeps; rows without words always are.

    Of rows with one word set only the first can be kept, as what drops it drops the others, so only first ones are compared. Resolved in rounds, without gathering pairs: a row all of whose earlier partners are dropped is kept, one with a kept
    earlier partner is dropped, and decided rows leave. A chain of n rows takes n rounds at most; in an order that has nothing to do
    with likeness, a number of rounds that grows with the logarithm of the rows.
    """
    sets = word_sets(rows, form, text)
    firsts = written(sets.groupBy("w").agg(F.min("ord").alias("ord")), "firsts")
    later = sets.select("ord").join(shuffled_side(firsts.select("ord")), "ord", "left_anti")
    undecided, gone = written(alike(firsts, threshold).select("ord_a", "ord_b"), "links"), [written(later, "later")]
    while not undecided.isEmpty():
        # kept for sure: no undecided earlier partner
        waiting = undecided.select(F.col("ord_b").alias("ord")).distinct()
        sure = undecided.select(F.col("ord_a").alias("ord")).distinct().join(shuffled_side(waiting), "ord", "left_anti")
        now = written(undecided.join(shuffled_side(sure), F.col("ord_a") == F.col("ord"), "left_semi").select(F.col("ord_b").alias("ord")).distinct(), "gone")
        gone.append(now)
        rest = written(undecided.join(shuffled_side(now), F.col("ord_b") == F.col("ord"), "left_anti").join(shuffled_side(now), F.col("ord_a") == F.col("ord"), "left_anti"), "links")
        removed(undecided)
        undecided = rest
        if len(gone) == 50:  # plans stay short
            gone = [written(reduce(DataFrame.union, gone), "gone")]
    return rows.join(shuffled_side(reduce(DataFrame.union, gone)), "ord", "left_anti")
