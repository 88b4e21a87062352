"""How filters act on each other: joint failures of all their intersections, inverted to survivors, unique failures, redundancy and Shapley values.

A document's failures are flags; the product of the flags of a set S of filters,
summed over documents, is J(S), the number that fail all of S. These 32 sums for
each part and each weight are all that is kept of the documents. By
inclusion-exclusion, survivors of a set T are the sum of (-1)^|S| J(S) over S within
T (a Moebius transform of J), from which follow what each step of an order removes
and what fails one filter alone. As a game of removed documents, the Harsanyi
dividend of S is (-1)^(|S|+1) J(S), and a filter's Shapley value shares each
dividend among its members.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, scratch

FILTERS = "ABCDE"
#: White space that ends a word, as a regular expression's class.
SPACE = r"\x20\x09-\x0D"


def failures(text: Column) -> dict[str, Column]:
    """Filters that look at one text: under 200 words; distinct words under half of all; over 2 % of the code points A-Z; any of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), 0)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a 0/1 column for each filter, good and toxic of each document; E fails a text that a smaller doc_id has.

    A null text is empty and a null source the part ''. Documents without a
    doc_id repeat none, and none repeats them; rows that share a doc_id don't repeat each other. A
    document is good, or toxic, if any label row of its doc_id says 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {k: v.cast("int") for k, v in failures(F.col("text")).items()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), *(v.alias(k) for k, v in own.items()))
    rows = Stored(rows, "flags").df
    # only texts that some other id has go into the join
    low = rows.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("text_key", "low")
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.join(low, "text_key", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)).cast("int")).drop("text_key", "low")
    return rows.join(said, "doc_id", "left").select("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def members(subset: int) -> str:
    return "".join(f for k, f in enumerate(FILTERS) if subset >> k & 1)


def joint_failures(rows: DataFrame) -> DataFrame:
    """One row for each part: j_n, j_good and j_toxic, arrays of J(S) by S as a number whose bit k is filter k; the empty set's is the number of documents."""
    every = range(1 << len(FILTERS))

    def product(subset: int, weight: Column | None) -> Column:
        out = weight if weight is not None else F.lit(1)
        for f in members(subset):
            out = out * F.col(f)
        return out

    weights = {"n": None, "good": F.col("good"), "toxic": F.col("toxic")}
    sums = rows.groupBy("part").agg(*(F.sum(product(s, w)).alias(f"{name}_{s}") for name, w in weights.items() for s in every))
    return sums.select("part", *(F.array(*(F.col(f"{name}_{s}") for s in every)).alias(f"j_{name}") for name in weights))


def _size(subset: Column) -> Column:
    return F.bit_count(subset)


def survivors(joint: Column) -> Column:
    """By T: how many fail none of T, the signed sum of J(S) over S within T."""
    signed = F.transform(joint, lambda j, s: F.when(_size(s) % 2 == 1, -j).otherwise(j))
    subsets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    within = lambda t: F.filter(signed, lambda _, s: s.bitwiseAND(t) == s)
    return F.transform(subsets, lambda t: F.aggregate(within(t), F.lit(0).cast("long"), lambda a, x: a + x))


def shapley(joint: Column) -> Column:
    """By filter: the dividends of the sets that hold it, each shared among the set's members; times the number of orders, so whole numbers."""
    orders = factorial(len(FILTERS))
    share = F.transform(joint, lambda j, s: F.when(_size(s) % 2 == 1, j).otherwise(-j) * (F.lit(orders) / F.greatest(F.lit(1), _size(s))).cast("long"))
    having = lambda f: F.filter(share, lambda _, s: s.bitwiseAND(F.lit(1 << f)) != 0)
    return F.array(*(F.aggregate(having(f), F.lit(0).cast("long"), lambda a, x: a + x) for f in range(len(FILTERS))))


def _steps() -> list[dict]:
    """Every step of every order: the filters before it as a set, and the filter itself."""
    out = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for k, f in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k, "before": done, "f": f})
            done |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with counts within the part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    An empty table has no parts. See ``flagged`` for nulls and repeats; other columns are ignored.
    """
    with scratch() as kept:
        joint = Stored(joint_failures(flagged(docs, labels)), "joint")
        kept.append(joint)
    all_ = (1 << len(FILTERS)) - 1
    known = joint.df.select("part", "j_n", *(survivors(F.col(f"j_{n}")).alias(f"left_{n}") for n in ("n", "good", "toxic")), shapley(F.col("j_n")).alias("shares"))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,before:int,f:int>>")
    rows = known.withColumn("_s", F.explode(steps)).select("*", "_s.*")
    bit = F.expr("shiftleft(1, f)")
    lost = lambda n: F.get(f"left_{n}", F.col("before")) - F.get(f"left_{n}", F.col("before").bitwiseOR(bit))
    alone = F.get("left_n", F.lit(all_).bitwiseXOR(bit)) - F.get("left_n", F.lit(all_))
    return rows.select("part", "filter_order", "step", F.get("left_n", F.col("before").bitwiseOR(bit)).alias("kept"), lost("n").alias("removed"), (F.get("j_n", bit) - lost("n")).alias("redundant"), alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"))
