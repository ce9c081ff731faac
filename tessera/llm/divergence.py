"""Source divergence audit: how far the terms of each source are from those of the others, by inclusion-exclusion over supports."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, require, split_words

#: Documents of a language that a term needs to be kept.
LEAST_DOCUMENTS = 10
#: Terms reported of a group.
TOP = 10
SCALE = 1_000_000_000
#: Different terms that a task counts before it hands them over.
HELD = 300_000
#: A term is a run of letters A-Z, a-z and characters beyond ASCII: all other bytes become blanks, A-Z lower case.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs``: occurrences of each term and the documents that hold it, added up once a task or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, str], Counter] = defaultdict(Counter)
        held: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in count.items():
                docs, names = held[lang, source], ["lang", "source", "term", "count", "docs"]
                columns = [[lang] * len(n), [source] * len(n), list(n), list(n.values()), [docs[t] for t in n]]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            count.clear()
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                own: set[bytes] = set()
                for terms in split_words(text, _TERMS):
                    count[lang, source].update(terms)
                    own.update(terms)
                held[lang, source].update(own)
            if sum(map(len, count.values())) > HELD:
                yield from told()
        yield from told()

    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    parts = texts.mapInArrow(run, "lang string, source string, term binary, count long, docs long")
    whole = parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    return whole.withColumn("term", F.col("term").cast("string"))


def _price(count: str, n: str, v: str) -> Column:
    """The price of a term with so many of n occurrences among v kept terms, in whole numbers."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10, 0)) * (cast({count} as decimal(19, 0)) + 2)) div cast(greatest({n} + 2 * {v}, 1L) as decimal(20, 0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def divergences(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of a language and a source.

    The terms of a language are those that ``least_documents`` of its rows hold. Every group prices each of them by its occurrences there, none
    included, and so does the language. Part ``pair`` has for each other source of the language the sum of gaps between the two
    prices of all terms, part ``term`` the ``top`` terms that the group holds and prices above the language.

    A sum over all terms is never formed term by term. If neither side held a term, each would cost its constant price: the number of terms times one gap.
    Terms of one side are added from the histogram of its counts, as their price depends on the count alone, against the other's constant. Only terms
    that both hold are met in a join of postings, which takes back what the two histograms said of them and adds the true gap. All numbers are whole and exact.

    Null text, lang and source count as empty. Each row counts as a document, repeated ones too. Ties go by the item's UTF-8 bytes. Other columns
    are ignored. A group without terms has its pairs, with value 0 if the language keeps no term. An empty table gives an empty table.
    """
    require(docs, ["text", "lang", "source"])
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs)
    kept = counted.select("*", F.sum("docs").over(term).alias("held"), F.sum("count").over(term).alias("total"), F.min("source").over(term).alias("lead"))
    postings = materialize(kept.where(F.col("held") >= least_documents).select("lang", "source", "term", "count", "total", "lead"), "postings")
    groups = materialize(_groups(docs, postings), "groups")
    named = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(_pairs(postings, groups).withColumn("part", F.lit("pair")))
    told = postings.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price("count", "n", "v").alias("p"), _price("total", "lang_n", "v").alias("q"))
    terms = _ranked(told.where("p > q").withColumn("value", _gap("p", "q"))).where(F.col("rank") <= top)
    out = materialize(pairs.select(*named).unionByName(terms.select(*named)), "divergences")
    drop(postings, groups)
    return out


def _groups(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, n, lang_n, v, p0``: occurrences of kept terms in the group and its language, the terms kept, and the price of an absent one."""
    own = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count_if(F.col("source") == F.col("lead")).alias("led"))
    whole = own.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("led").alias("v"))
    all_ = docs.select("lang", "source").distinct().join(own.drop("led"), ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["n", "lang_n", "v"])
    return all_.withColumn("p0", _price("0", "n", "v"))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    two = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    constant = two.select("lang", "source", "item", (F.col("v") * _gap("p0", "q0")).alias("value"))
    # terms of one side, by their counts
    hist = postings.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    hist = hist.select("lang", "source", "terms", "p0", _price("count", "n", "v").alias("p")).join(other, "lang").where(F.col("source") != F.col("item"))
    one = hist.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("value"))
    # terms of both sides
    priced = postings.join(groups, ["lang", "source"]).select("lang", "term", "source", "p0", _price("count", "n", "v").alias("p"))
    met = priced.join(priced.select("lang", "term", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q")), ["lang", "term"]).where(F.col("source") < F.col("item"))
    both = met.groupBy("lang", "source", "item").agg(F.sum(_gap("p", "q") - _gap("p", "q0") - _gap("p0", "q") + _gap("p0", "q0")).alias("value"))
    mirrored = one.unionByName(both)
    mirrored = mirrored.unionByName(mirrored.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return constant.unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(values: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return values.withColumn("rank", F.row_number().over(order))
