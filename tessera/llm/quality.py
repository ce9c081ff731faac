"""Quality rules: text statistics in Spark expressions, and a learned, readable decision list over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, let, require

#: Labelled rows that the list is learned from at most (the bound that keeps the driver's part small).
MOST_LABELLED = 12_000
#: What the learned rules may look at; each is a ratio or a count of one text.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio")
#: Up to so many distinct repeated windows are looked up one by one; texts with more are sorted instead.
FEW = 48
_SPACES = r"[\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows which occur twice or more in the text."""
    longs = "array<bigint>"

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twins = lambda s: F.transform(
            s, lambda v, j: F.when((v["x"] == F.get(s, j - 1)["x"]) | (v["x"] == F.get(s, j + 1)["x"]), v["i"])
        )
        return F.sort_array(F.filter(let(pairs, twins), lambda i: i.isNotNull()))

    def places(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))

        def of(twice: Column) -> Column:
            listed = F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i))
            return (
                F.when(F.size(twice) == 0, F.array().cast("array<int>"))
                .when(F.size(twice) <= FEW, F.filter(listed, lambda i: i.isNotNull()))
                .otherwise(by_sort(hashes))
            )

        return let(twice, of)

    whole = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    hashes = F.when(F.size(words) >= 3, F.slice(whole, F.lit(1), F.size(words) - 2)).otherwise(F.array().cast(longs))
    return let(hashes, lambda h: let(places(h), covered))


def statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the counts that the rules use to each row; a null text has no words, lines or symbols.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``[#*$%&|<>]``),
    ``n_dup_lines`` (lines with a word that equal an earlier one), ``n_repeat_words`` (words in
    three-word windows found twice or more), and the features ``FEATURES`` that follow from them; each name begins with ``prefix``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, _SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = lambda name: f"{prefix}{name}"
    free = free_prefix([*docs.columns, prefix])
    words_, lines_ = f"{free}words", f"{free}lines"
    out = docs.withColumns({words_: words, lines_: lines})
    counts = {
        "n_words": F.size(words_),
        "word_chars": F.char_length(F.regexp_replace(body, _SPACES, "")),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
        "n_marks": F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D\p{L}\p{N}.,]")),
        "n_upper": F.regexp_count(body, F.lit(r"[A-Z]")),
        "n_lines": F.size(lines_),
        "n_dup_lines": F.size(lines_) - F.size(F.array_distinct(lines_)),
        "n_repeat_words": let(F.col(words_), _repeat_words),
    }
    out = out.withColumns({own(name): count.cast("long") for name, count in counts.items()}).drop(words_, lines_)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(own(a)).cast("double"), F.col(own(b)).cast("double")), F.lit(0.0))
    ratios = {
        "mean_word": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "mark_ratio": ratio("n_marks", "word_chars"),
    }
    return out.withColumns({own(name): value for name, value in ratios.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        value = F.col(f"{prefix}{self.feature}")
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def learn(
    rows: Sequence[tuple], features: Sequence[str] = FEATURES, bins: int = 40, most_rules: int = 16, precision: float = 0.95, least: int = 5
) -> list[Rule]:
    """Sequential covering on labelled rows ``(*features, bad)``: an ordered list of conjunctions that tell bad rows.

    A rule grows on two thirds of the rows by the threshold condition of the highest information gain,
    until it covers no good row or nothing gains; it is pruned on the other third by dropping its last
    conditions while that does not lower (p - n) / (p + n). It joins the list if it covers at least
    ``least`` bad rows of all and its precision reaches ``precision`` on all rows and on the third it
    did not grow on. Rows it covers are then removed. Sets of rows are the bits of integers.
    """
    from math import log2

    n = len(rows)
    if not n:
        return []
    every = (1 << n) - 1
    bad = sum(1 << i for i, r in enumerate(rows) if r[-1])
    held = sum(1 << i for i in range(n) if i % 3 == 2)
    tests: list[tuple[Condition, int]] = []
    for k, name in enumerate(features):
        order = sorted(range(n), key=lambda i: rows[i][k])
        values = [rows[i][k] for i in order]
        cuts = sorted({values[min(n - 1, j * n // bins)] for j in range(1, bins)} | {values[-max(1, n // d)] for d in (50, 100, 200, 400)})
        below, at = 0, 0
        for cut in cuts:
            while at < n and values[at] < cut:
                below |= 1 << order[at]
                at += 1
            if below and below != every:
                tests += [(Condition(name, True, float(cut)), every & ~below), (Condition(name, False, float(cut)), below)]
    rules: list[Rule] = []
    left = every
    while len(rules) < most_rules and (bad & left).bit_count() >= least:
        grown: list[tuple[Condition, int]] = []
        cover = left & ~held
        while True:
            p, m = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            if not m or not p:
                break
            best, gain = None, 1e-9
            for test in tests:
                q, w = (cover & test[1] & bad).bit_count(), (cover & test[1] & ~bad).bit_count()
                if q and (g := q * (log2(q / (q + w)) - log2(p / (p + m)))) > gain:
                    best, gain = test, g
            if best is None:
                break
            grown.append(best)
            cover &= best[1]

        def score(conditions: list[tuple[Condition, int]], of: int) -> tuple[int, int]:
            for _, rows_of in conditions:
                of &= rows_of
            return (of & bad).bit_count(), (of & ~bad).bit_count()

        def worth(conditions: list[tuple[Condition, int]]) -> float:
            p, m = score(conditions, left & held)
            return (p - m) / (p + m) if p + m else -1.0

        while len(grown) > 1 and worth(grown[:-1]) >= worth(grown):
            grown.pop()
        if not grown:
            break
        p, m = score(grown, left)
        hp, hm = score(grown, left & held)
        if p < least or p < precision * (p + m) or hp < precision * (hp + hm):
            break
        rules.append(tuple(c for c, _ in grown))
        gone = left
        for _, rows_of in grown:
            gone &= rows_of
        left &= ~gone
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple]:
    """The features and the label of at most ``most`` labelled documents, taken in the order of a hash of their id.

    Of several labels of one id the least counts, and of several rows of one id that of the least features, so that
    no more than ``most`` rows reach the driver; null ids and labels are left out.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    row = F.min(F.struct(*FEATURES, (F.col("quality") == 0).alias("bad"))).alias("row")
    return [tuple(r[1]) for r in sorted(rows.groupBy("doc_id").agg(row).collect(), key=tuple)]


def decision_list(rules: list[Rule], prefix: str = "") -> Column:
    """The first rule that holds for a row, in words, or null: an ordered conditional expression."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = rule[0].column(prefix)
        for c in rule[1:]:
            holds = holds & c.column(prefix)
        out = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, prefix: str = "") -> DataFrame:
    """Every row of ``docs`` with its statistics, ``base_failed``, ``reason`` (the learned rule that fired, or null) and ``kept``.

    A text fails the base rules with fewer than 50 words or with more than half of its words in repeated
    three-word windows; null and empty texts do. Without usable labels no rule is learned and the base
    rules decide alone. Labels of absent documents are ignored; rows without an id and repeated rows are judged each by their
    text; whole texts are read, however long, each by itself. Other columns stay; columns named like a new one are replaced, unless a
    ``prefix`` for the new ones keeps them apart. An empty table gives no rows. Ties of features fall on one side of a threshold.
    """
    require(docs, ["doc_id", "text"])
    require(labels, ["doc_id", "quality"])
    rules = learn(labelled_rows(docs, labels, most_labelled))
    n_words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    out = statistics(docs, prefix=prefix).withColumn(f"{prefix}base_failed", (n_words < 50) | (100 * repeats > 50 * n_words))
    out = out.withColumn(f"{prefix}reason", decision_list(rules, prefix))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & F.col(f"{prefix}reason").isNull())


def only_kept(judged: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """The columns named of the rows that are kept.

    A plain filter would be pushed below the statistics and compute them once for each time that it
    mentions them; a generator that gives one row or none stays above them.
    """
    mark = f"{free_prefix(columns)}mark"
    return judged.select(*columns, F.explode(F.filter(F.array(f"{prefix}kept"), lambda k: k)).alias(mark)).drop(mark)
