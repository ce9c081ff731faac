"""Benchmark decontamination by template canonicalisation, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_empty, let, materialize, require, screen, without

#: Words of a template window.
WINDOW = 5
#: A document holds an item if it has this share of the item's windows.
SIMILARITY = 0.8
#: Literal words that a window needs at least; placeholders alone say nothing.
LITERALS = 2
#: Windows of the benchmark up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Windows that no more items have are looked up in any case; of more common ones only those that an item cannot do without.
RARE = 8

#: Placeholders; the first character does not occur in ordinary text.
MARK, NAME, NUMBER, UNIT = "\x01", "\x01n", "\x01d", "\x01u"
#: Units of measure that follow a number (fixed values).
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|yd|l|ml|gal|h|hr|hrs|min|s|sec|ms|days?|hours?|minutes?|seconds?|years?|miles?|meters?|metres?|grams?|dollars?|euros?|cents?|percent|mph|kmh|kw|w|v|a|hz|mb|gb|tb"
#: Numbers in words (fixed values).
ONES = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
TENS, GREAT = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety", "zero|dozen|hundred|thousand|million|billion"
_SPELLED = rf"(?i)(?<![\p{{L}}\p{{M}}\d'’-])(?:(?:{TENS})(?:-(?:{ONES}))?|{ONES}|{GREAT})(?![\p{{L}}\p{{M}}\d'’-])"
_SPACES = r"[\x20\x09-\x0D]+"
#: A capitalised word after a word that does not end a sentence, and one anywhere.
_NAME_INSIDE = r"\p{Lu}(?<=[\p{Ll}\d,;:] .)\p{Ll}[\p{L}\p{M}'’-]*"
_NAME_ANYWHERE = r"\p{Lu}(?<![\p{L}\p{M}\d'’-].)\p{Ll}[\p{L}\p{M}'’-]*"


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(""))


def _measured(text: Column, spelled: bool = True) -> Column:
    """The text with numbers, also in words if ``spelled``, and the units after them replaced."""
    text = F.regexp_replace(_unmarked(text), r"\d+(?:[.,:/]\d+)*", NUMBER)
    if spelled:
        text = F.regexp_replace(text, _SPELLED, NUMBER)
    return F.regexp_replace(text, rf"(?i){NUMBER}(\x20?)(?:{UNITS})(?![\p{{L}}\p{{M}}\d])", f"{NUMBER}$1{UNIT}")


def template(text: Column) -> Column:
    """The text in lower case with names, numbers and units replaced word for word by typed placeholders.

    A name is a capitalised word after a word that does not end a sentence; a number is a run of digits
    with its separators; a unit is a word of ``UNITS`` right after a number, attached or apart.
    """
    return F.lower(F.regexp_replace(_measured(text, spelled=False), _NAME_INSIDE, NAME))


def _words(text: Column) -> Column:
    """The words of a text; a text without any gives one empty word, which no window holds."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), _SPACES)


def _prepared(table: DataFrame, key: str, *others: str) -> DataFrame:
    """The words of each text (``o``) and, word for word, three templates of it with single blanks between them:
    names as in ``template`` (``t``), every capitalised word a name (``a``), and none (``l``)."""
    rows = table.where(f"{key} is not null and text is not null").select(key, *others, _words(_unmarked(F.col("text"))).alias("o"))
    rows = rows.select(key, *others, "o", _measured(F.array_join("o", " ")).alias("m"))
    split = lambda text: F.split(F.lower(text), " ")
    names = {"t": F.regexp_replace("m", _NAME_INSIDE, NAME), "a": F.regexp_replace("m", _NAME_ANYWHERE, NAME), "l": F.col("m")}
    return rows.select(key, *others, "o", *[split(text).alias(c) for c, text in names.items()])


def _merged(rows: DataFrame) -> DataFrame:
    """Adds ``m``, the words of ``a`` with names of several words as one, and ``mo``, the words that each stands for."""

    def words(row: Column) -> Column:
        a, o = row["a"], row["o"]
        follows = lambda w, i: F.coalesce(F.get(a, i - 1).endswith(NAME) & w.startswith(NAME), F.lit(False))
        heads = F.filter(F.transform(a, lambda w, i: F.when(~follows(w, i), i)), lambda i: i.isNotNull())

        def merge(heads: Column) -> Column:
            def one(h: Column, k: Column) -> Column:
                n = F.coalesce(F.get(heads, k + 1), F.size(a)) - h
                tails = F.transform(F.slice(a, h + 2, n - 1), lambda w: F.substring(w, F.lit(len(NAME) + 1), F.char_length(w)))
                return F.struct(F.concat(F.get(a, h), F.array_join(tails, "")).alias("m"), F.array_join(F.slice(o, h + 1, n), " ").alias("mo"))

            return F.transform(heads, one)

        return let(heads, merge)

    rows = rows.withColumn("__words", let(F.struct("a", "o"), words))
    return rows.withColumns({"m": F.col("__words")["m"], "mo": F.col("__words")["mo"]}).drop("__words")


#: The ways in which a text is read: how its windows are told, their words and what these stand for.
_READINGS = {"t": ("text", "t", "o"), "a": ("text", "a", "o"), "l": ("text", "l", "o"), "m": ("merged", "m", "mo"), "r": ("raw", "r", "o")}


#: The columns in which the windows of candidates are sought; ``g`` has names of several words as one, and is null where there are none.
_TEMPLATES = ("t", "a", "l", "r", "g")
#: A name after a name, which ``g`` leaves out.
_NAME_AGAIN = f"(?<={NAME}) {NAME}"


def _hash(mode: Column, words: list[Column]) -> Column:
    """Hash of a window by those of its words; a null beyond its end counts for nothing."""
    return F.xxhash64(mode, *words)


def _window_hashes(mode: str, words: Column, width: int) -> Column:
    """Hash of each window of ``width`` words; none in a text with fewer."""

    def of(hashed: Column) -> Column:
        whole = F.transform(hashed, lambda w, i: _hash(F.lit(mode), [w, *[F.get(hashed, i + j) for j in range(1, width)]]))
        return F.slice(whole, F.lit(1), F.greatest(F.size(hashed) - (width - 1), F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda w: ~F.contains(w, F.lit(MARK))))


def _variants(t: Column, a: Column, l: Column) -> Column:  # noqa: E741
    """All windows that take at each place the word of one of three templates."""
    out = F.array(F.array().cast("array<string>"))

    def longer(here: Column) -> Callable[[Column], Column]:
        return lambda made: F.transform(here, lambda w: F.when(w.isNull(), made).otherwise(F.concat(made, F.array(w))))

    for j in range(WINDOW):
        here = F.array_distinct(F.array(*[F.get(c, F.lit(j)) for c in (t, a, l)]))  # a null beyond the end
        out = F.flatten(F.transform(out, longer(here)))
    return out


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``mode, hash, key, width, item_id, q, v, slots, strict, usable, n, n_strict``: the windows ``v`` of all items, each variant a row.

    In the mode ``text`` a capitalised word stands in the windows as a placeholder and as itself; ``strict`` says that the names are
    those of ``template``; ``n_strict`` counts the windows that are usable so, and ``n`` those that are usable
    with every capitalised word as a name, or, if there are none, by their literal words. In the mode ``merged`` a name of several
    words is one placeholder. An item without a usable window is there in the mode ``raw``, by its plain words in lower case.
    ``key`` is the hash by which documents are looked up, alike for ``text`` and ``merged``.
    """
    one = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    rows = _merged(_prepared(one, "item_id")).where("o[0] != ''")

    def cut(mode: str, columns: str, of: str) -> DataFrame:
        wide = rows.withColumn("width", F.least(F.size(of), F.lit(WINDOW)))
        window = lambda row, q: F.struct(q.alias("q"), *[F.slice(row[c], q + 1, row["width"]).alias(c) for c in columns.split()])
        places = F.sequence(F.lit(0), F.size(of) - F.col("width"))
        windows = let(F.struct("width", *columns.split()), lambda row: F.transform(places, lambda q: window(row, q)))
        return wide.select("item_id", "width", F.lit(mode).alias("mode"), F.inline(windows))

    text = cut("text", "o t a l", "o").select("*", F.explode(_variants(F.col("t"), F.col("a"), F.col("l"))).alias("v")).where(_literals(F.col("v")) >= LITERALS)
    by = lambda c: F.count_distinct(F.when(F.col("v") == F.col(c), F.col("q")))
    sizes = text.groupBy("item_id").agg(by("t").alias("n_strict"), by("a").alias("n_any"), by("l").alias("n_literal"))
    text = text.join(sizes, "item_id").withColumns(
        {
            "strict": F.col("v") == F.col("t"), "usable": (_literals(F.col("a")) >= LITERALS) | (F.col("n_any") == 0),
            "n": F.when(F.col("n_any") > 0, F.col("n_any")).otherwise(F.col("n_literal")),
        }
    )
    merged = cut("merged", "m mo", "mo").withColumn("v", F.col("m")).where(_literals(F.col("v")) >= LITERALS).withColumn("o", F.col("mo"))
    known = [text, merged]
    raw = cut("raw", "o", "o").withColumn("v", F.transform("o", lambda w: F.lower(w)))
    for part in known:
        raw = raw.join(part.select("item_id").distinct(), "item_id", "left_anti")
    plain = []
    for part in (merged, raw):
        counted = part.join(part.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")
        plain.append(counted.withColumns({"strict": F.lit(False), "usable": F.lit(True), "n_strict": F.lit(0).cast("long")}))
    said = F.when(F.col("mode") != "raw", F.transform("v", lambda w, i: F.when(F.contains(w, F.lit(MARK)), F.struct(i.alias("at"), F.lower(F.get("o", i)).alias("word")))))
    slots = F.coalesce(F.filter(said, lambda s: s.isNotNull()), F.array().cast("array<struct<at:int,word:string>>"))
    words = [F.get("v", F.lit(j)) for j in range(WINDOW)]
    hashed = lambda mode: _hash(mode, [F.when(w.isNotNull(), F.xxhash64(w)) for w in words])
    columns = ["mode", hashed(F.col("mode")).alias("hash"), hashed(_looked_up(F.col("mode"))).alias("key"), "width", "item_id", "q", "v", slots.alias("slots"), "strict", "usable", "n", "n_strict"]
    return text.select(columns).unionByName(plain[0].select(columns)).unionByName(plain[1].select(columns))


def _looked_up(mode: Column) -> Column:
    """The mode with which windows are hashed for the search: a text without names of several words reads the same with them as one."""
    return F.when(mode == "merged", "text").otherwise(mode)


def _keys(known: DataFrame, similarity: float) -> DataFrame:
    """``key, items``: the windows by which items are looked up, and which items each stands for.

    A document that holds an item in one of the readings has all but a few of the item's windows of that reading, so it has one at least
    of any few more. The rarest that many of each reading are enough, and so windows that many items have are left out where an item has rarer ones.
    """
    spread = known.groupBy("key").agg(F.count_distinct("item_id").alias("items"))
    of = known.join(spread, "key").groupBy("item_id", "mode", "q").agg(
        F.max("items").alias("freq"), F.bool_or("usable").alias("usable"), F.bool_or("strict").alias("strict"), F.max("n").alias("n"), F.max("n_strict").alias("n_strict")
    )
    rank = lambda flag: F.sum(F.col(flag).cast("int")).over(Window.partitionBy("item_id", "mode").orderBy("freq", "q").rowsBetween(Window.unboundedPreceding, 0))
    least = lambda n: F.col(n) - F.ceil(F.col(n) * similarity) + 1
    ranked = of.withColumns({"__u": rank("usable"), "__s": rank("strict")})
    some = ranked.where((F.col("freq") <= RARE) | (F.col("usable") & (F.col("__u") <= least("n"))) | (F.col("strict") & (F.col("__s") <= least("n_strict"))))
    return known.join(some.select("item_id", "mode", "q"), ["item_id", "mode", "q"]).groupBy("key").agg(F.collect_set("item_id").alias("items"))


def _candidates(docs: DataFrame, known: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """``doc_id, item_id``: documents with a window by which an item is looked up."""
    lengths = sorted(tuple(r) for r in known.select(_looked_up(F.col("mode")), "width").distinct().collect())  # at most twice WINDOW rows
    rows = _prepared(docs, "doc_id").withColumn("r", F.transform("o", lambda w: F.lower(w)))
    named = F.array_join("a", " ")
    rows = rows.withColumn("g", F.when(F.contains(named, F.lit(f"{NAME} {NAME}")), F.split(F.regexp_replace(named, _NAME_AGAIN, ""), " ")))
    # The words of a text are dealt out by place, and the windows hashed there, in compiled code; the outer form
    # keeps the optimiser from making the words twice, for a filter on their number.
    rows = rows.select("doc_id", *_TEMPLATES, F.posexplode_outer("o").alias("p", "w"))
    hashes: list[Column] = []
    for mode, width in lengths:
        for c in {"text": "talg", "raw": "r"}[mode]:
            whole = F.col("p") <= F.size(c) - width
            here = F.when(whole, _hash(F.lit(mode), [F.xxhash64(F.get(F.col(c), F.col("p") + j)) for j in range(width)]))
            rows = rows.withColumn(f"h{len(hashes)}", here)
            hashes.append(F.col(f"h{len(hashes)}"))
    new = [F.when(reduce(lambda ok, g: ok & ~h.eqNullSafe(g), hashes[:i], F.lit(True)), h) for i, h in enumerate(hashes)]
    rows = rows.select("doc_id", F.explode_outer(F.array(*new)).alias("key"))
    met = rows.join(F.broadcast(keys) if small else keys, "key")
    return met.select("doc_id", F.explode("items").alias("item_id")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, n_matched, n_windows, n_slots``: documents that hold an item, also one with other parameters.

    Texts and items become templates, whatever white space is between their words, and the windows of five
    template words are joined by their hash. Whether a capitalised word is a name cannot be told where a
    sentence begins, nor whether a word is one where its capital is lost; so a document's window is looked
    up three times (see ``_prepared``), and an item's window is there with each of its capitalised words as
    a placeholder and as itself. An item of fewer than five words is one window, and one without a usable window is
    looked for by its plain words. Windows with fewer than ``LITERALS`` literal words are not used otherwise.

    Numbers in words count as numbers, and every text is also read with names of several words as one.

    That join finds candidates, by windows of any reading that few items have. Their windows are then compared word by word with those of the
    items that they may hold. Matches that put an item at
    one place of a document must fill its slots consistently: equal names, numbers or units of the item
    stand for equal ones in the document and the other way round. A document holds an item if the matches
    at consistent places, all of them, only those with the names of ``template`` on both sides, or those with merged names, cover
    ``similarity`` or more of the item's windows.

    Null ids and texts take no part, and empty texts hold nothing; rows that share a
    doc_id are one document, and of rows that share an item_id the least text is used; empty tables give no rows;
    other columns are ignored; all windows of a long text are looked up. The benchmark's windows are broadcast only while they and the items behind them number at
    most ``BROADCAST_WINDOWS``, which is checked; a larger benchmark is shuffled, and so are the hashes of the documents' windows
    then. The texts of candidates alone are read twice.
    """
    require(docs, ["doc_id", "text"])
    require(benchmark, ["item_id", "text"])
    known = materialize(benchmark_windows(benchmark), "benchmark-windows")
    keys = materialize(_keys(known, similarity), "benchmark-keys")
    small = (keys.agg(F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST_WINDOWS
    kind = benchmark.schema["item_id"].dataType
    if is_empty(keys):
        return docs.where("false").selectExpr("doc_id", "null as item_id", "0L as n_matched", "0L as n_windows", "0L as n_slots").withColumn("item_id", F.col("item_id").cast(kind))
    found = materialize(_candidates(docs, known, keys, small), "leak-candidates")
    marks = materialize(known.groupBy("item_id").agg(F.collect_set("hash").alias("marks")), "benchmark-marks")
    wanted = found.join(marks, "item_id").groupBy("doc_id").agg(F.collect_list("item_id").alias("items"), F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"))
    texts = screen(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", found).join(wanted, "doc_id")
    lengths = sorted(tuple(r) for r in known.select("mode", "width").distinct().collect())  # three times WINDOW rows at most
    rows = _merged(_prepared(texts, "doc_id", "items", "marks")).withColumn("r", F.transform("o", lambda w: F.lower(w)))

    def cut(reading: str, width: int) -> Column:
        """The windows of one reading and width that the items which the document may hold have."""
        mode, said, words = _READINGS[reading]

        def windows(row: Column) -> Column:
            part = lambda c, i: F.slice(row[c], i + 1, width)
            window = lambda h, i: F.struct(F.lit(reading).alias("reading"), h.alias("hash"), i.alias("p"), part("said", i).alias("said"), part("words", i).alias("words"))
            some = let(F.array_intersect(row["hashes"], row["marks"]), lambda met: F.transform(row["hashes"], lambda h, i: F.when(F.array_contains(met, h), window(h, i))))
            return F.filter(some, lambda w: w.isNotNull())

        return let(F.struct(F.col(said).alias("said"), F.col(words).alias("words"), F.col("marks"), _window_hashes(mode, F.col(said), width).alias("hashes")), windows)

    windows = F.concat(*[cut(reading, width) for mode, width in lengths for reading, (own, _, _) in _READINGS.items() if own == mode])
    hits = rows.select("doc_id", "items", F.inline(windows)).withColumn("item_id", F.explode("items")).drop("items")
    met = hits.join(known, ["hash", "item_id"]).where(F.col("said") == F.col("v"))
    pairs = F.transform("slots", lambda s: F.struct(s["word"].alias("a"), F.lower(F.get("words", s["at"])).alias("b")))
    side = lambda name, n: F.struct(F.lit(name).alias("side"), F.col(n).alias("n"))
    strict, plain = (F.col("reading") == "t") & F.col("strict"), F.col("mode") != "text"
    sides = F.array(F.when(strict, side("strict", "n_strict")), F.when(F.col("usable") & ~plain, side("any", "n")), F.when(plain, F.struct(F.col("mode").alias("side"), F.col("n"))))
    met = met.select("doc_id", "item_id", "q", (F.col("p") - F.col("q")).alias("place"), pairs.alias("pairs"), F.inline(F.filter(sides, lambda x: x.isNotNull())))
    at_place = met.groupBy("doc_id", "item_id", "side", "n", "place").agg(
        F.collect_set("q").alias("qs"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    own = lambda s: F.size(F.array_distinct(F.transform("pairs", lambda z: z[s])))
    steady = at_place.where((own("a") == F.size("pairs")) & (own("b") == F.size("pairs")))
    held = steady.groupBy("doc_id", "item_id", "side", F.col("n").alias("n_windows")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).cast("long").alias("n_matched"),
        F.max(F.size("pairs")).cast("long").alias("n_slots"),
    )
    held = held.where(F.col("n_matched") >= similarity * F.col("n_windows"))
    best = F.max(F.struct(F.col("n_matched") / F.col("n_windows"), "n_matched", "n_windows", "n_slots")).alias("best")
    return held.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_matched", "best.n_windows", "best.n_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item; rows without an id or a text stay."""
    return without(docs, "doc_id", materialize(leaks(docs, benchmark, similarity).select("doc_id").distinct(), "leaks"))
