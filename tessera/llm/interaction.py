"""Filter interaction audit: what each filter of a chain removes in every order, and its Shapley share."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, require

#: The filters in the order of their bits; the last is the one against copies.
FILTERS = "ABCDE"


def failed(text: Column) -> Column:
    """Bits of the filters, but for copies, that a text fails.

    A: under 100 words; B: under 80 different words in 100; C: over 10 capitals A-Z in 100 characters; D: one of ``#$%&*|``.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    conditions = [n < 100, different.cast("long") * 100 < n.cast("long") * 80, capitals * 100 > F.length(text).cast("long") * 10, text.rlike(r"[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: the documents of a part that fail just the filters of a mask, all and of each label.

    Copies are told by the digest of the whole text. Rows of one digest, part and mask are added up before they are exchanged, and of them only the
    first id is kept apart, so that a large group of copies is a few rows.
    """
    text = F.coalesce("text", F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), failed(text).alias("mask"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    told = told.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    sums = ["n", "good", "toxic"]
    ids = told.groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    own = F.struct("doc_id", *sums)
    parts = ids.groupBy("digest", "part", "mask").agg(*(F.sum(c).alias(c) for c in sums), F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("first"), *(F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"free_{c}") for c in sums))
    parts = parts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    leads = F.col("first.doc_id") == F.col("least")
    passing = [(F.when(leads, F.col(f"first.{c}")).otherwise(0) + F.col(f"free_{c}")).alias(c) for c in sums]
    copies = [(F.col(c) - F.when(leads, F.col(f"first.{c}")).otherwise(0) - F.col(f"free_{c}")).alias(c) for c in sums]
    both = parts.select("part", F.inline(F.array(F.struct(F.col("mask"), *passing), F.struct((F.col("mask") + F.lit(1 << (len(FILTERS) - 1))).alias("mask"), *copies))))
    return both.where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in sums))


class Removal:
    """The multilinear extension of how many documents a set of filters removes.

    Of n documents with a mask, a set of filters drawn with probabilities x removes n (1 - product of 1 - x over the mask). Multiplied
    out and summed over the masks, this is one polynomial with a coefficient for each set of filters.
    """

    def __init__(self, counts: dict[int, int]) -> None:
        self.coefficients = {}
        for s in range(1, 1 << len(FILTERS)):
            sign = 1 if s.bit_count() % 2 else -1
            self.coefficients[s] = sign * sum(n for mask, n in counts.items() if mask & s == s)

    def at(self, corner: int) -> int:
        """How many the filters of a corner remove: the terms whose filters are all in it."""
        return sum(c for s, c in self.coefficients.items() if s & corner == s)

    def shapley(self, i: int) -> Fraction:
        """The integral of the partial derivative by filter i along the diagonal."""
        return sum((Fraction(c, s.bit_count()) for s, c in self.coefficients.items() if s >> i & 1), Fraction(0))


def orders(counts: dict[int, tuple[int, int, int]]) -> Iterator[dict]:
    """The rows of one part, from the counts of its masks: all, good and toxic documents."""
    n, good, toxic = (Removal({m: c[k] for m, c in counts.items()}) for k in range(3))
    total, every = sum(c[0] for c in counts.values()), (1 << len(FILTERS)) - 1
    shares = [n.shapley(i) * factorial(len(FILTERS)) for i in range(len(FILTERS))]
    if any(s.denominator != 1 for s in shares):
        raise ArithmeticError("a share times the number of orders is whole")
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = n.at(after) - n.at(before)
            yield {
                "filter_order": "".join(FILTERS[k] for k in order), "step": step, "filter": FILTERS[i], "kept": total - n.at(after), "removed": removed,
                "redundant": n.at(1 << i) - removed, "unique_fails": n.at(every) - n.at(every & ~(1 << i)), "good_lost": good.at(after) - good.at(before),
                "toxic_lost": toxic.at(after) - toxic.at(before), "shapley": int(shares[i]),
            }
            before = after


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (language), order of the five filters and step of the order, zeros included.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant`` fail its filter but went before, ``unique_fails`` fail its
    filter only, ``good_lost`` and ``toxic_lost`` are the labelled ones removed; ``shapley`` is what the filter removes, summed over all 120 orders.
    Filters A to D look at the whole text (``failed``); E removes a text that a smaller id has, whatever becomes of that. Masks
    of failed filters are counted by Spark; a part's 32 counts make its removal polynomial, whose corners give the survivors of any set of filters.

    Null text and language count as empty. A row without id is no copy, nor is anything a copy of it. Rows that repeat an id each count, and are no
    copies of each other. Of several labels of an id, 1 wins; null ids have none. Other columns are ignored. An empty table gives no rows.
    """
    require(docs, ["doc_id", "text", "lang"])
    require(labels, ["doc_id", "quality", "toxic"])
    masks = mask_counts(docs, labels)
    parts = masks.groupBy("part").agg(F.collect_list(F.array(F.col("mask").cast("long"), "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                made = pd.DataFrame(orders({int(m): (int(n), int(g), int(t)) for m, n, g, t in counts}))
                made.insert(0, "part", part)
                yield made

    longs = ", ".join(f"{c} long" for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split())
    return parts.mapInPandas(run, f"part string, filter_order string, step int, filter string, {longs}")
