"""Names matched to records by their longest common substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import match_key
from tessera.session import checkpointed


#: Once sizes are halved down to so many characters, all that are left are asked at once, which saves rounds.
AT_ONCE = 2
#: Substrings of names up to which they are broadcast to those that are asked for.
FEW = 1 << 20
#: Characters that stand for any run of characters and for any one, as in a pattern of SQL.
_WILD = "[%_]"


def _pieces(texts: DataFrame, text: str, size: Column, *others: str) -> DataFrame:
    """The others of each row with ``at`` and ``piece``: all substrings of ``size`` characters of its text, from the left."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    rows = texts.where((size > 0) & (F.char_length(text) >= size)).select(*others, F.col(text).alias("_of"), size.alias("_n"), F.explode(starts).alias("at"))
    return rows.select(*others, "at", F.substring(F.col("_of"), F.col("at"), F.col("_n")).alias("piece"))


def _hashed(piece: str) -> list[Column]:
    """Two hashes, 128 bits together, by which pieces of any length meet."""
    return [F.xxhash64(piece).alias("_h"), F.xxhash64(piece, F.lit(1)).alias("_g")]


def _matched(asked: DataFrame, names: DataFrame, longest: int, sizes: list[int] | None = None) -> DataFrame:
    """``piece, name``: of the pieces of ``asked`` each with the names that hold it; ``%`` and ``_`` are wildcards unless
    ``sizes`` says that there are none, with the sizes of all pieces.

    A piece meets the substrings of its own length of all names in an equality join. One with wildcards meets them by its longest run of
    other characters and is then compared as a pattern; one of wildcards alone is held by every name that is long enough.
    """
    pieces = asked.select("piece").distinct()
    if sizes is not None:
        return _holding(names, sizes).join(pieces.select("piece", *_hashed("piece")), ["_h", "_g"]).select("piece", "name")
    pieces = pieces.withColumn("_wild", F.col("piece").rlike(_WILD))
    runs = F.split("piece", _WILD + "+")
    longest_run = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.char_length(r) > F.char_length(best), r).otherwise(best))
    pieces = pieces.withColumn("_anchor", F.when(F.col("_wild"), longest_run).otherwise(F.col("piece")))
    sizes = [r[0] for r in pieces.select(F.char_length("_anchor").alias("n")).where(f"n between 1 and {longest}").distinct().collect()]
    held = _holding(names, sizes)
    anchored = pieces.where("_anchor != ''").select("piece", "_wild", *_hashed("_anchor"))
    bare = pieces.where("_anchor = ''").select("piece", "_wild", F.regexp_count("piece", F.lit("_")).alias("_least"))
    met = held.join(anchored, ["_h", "_g"]).select("piece", "_wild", "name")
    quoted = F.concat(F.lit("(?s)\\Q"), F.replace(F.replace("piece", F.lit("%"), F.lit("\\E.*\\Q")), F.lit("_"), F.lit("\\E.\\Q")), F.lit("\\E"))
    met = met.where(~F.col("_wild") | F.regexp_like("name", quoted)).select("piece", "name")
    # a name of n characters holds every bare pattern of at most so many single wildcards
    free = names.withColumn("_n", F.char_length("name")).join(F.broadcast(bare), F.col("_n") >= F.col("_least")).select("piece", "name") if bare.take(1) else None
    return met.unionByName(free) if free is not None else met


def _holding(names: DataFrame, sizes: list[int]) -> DataFrame:
    """``name, _h, _g``: the substrings of the sizes of each name, by their hashes."""
    sized = names.select("name", F.explode(F.array(*map(F.lit, sorted(sizes) or [0]))).alias("_size"))
    return _pieces(sized, "name", F.col("_size"), "name").select("name", *_hashed("piece"))


def _few(names: DataFrame, sizes: list[int]) -> bool:
    """Whether the names have so few substrings of these sizes that they may be broadcast."""
    n = F.char_length("name")
    held = names.agg(sum((F.sum(F.greatest(n - size + 1, F.lit(0))) for size in sizes), F.lit(0))).first()[0] or 0
    return held <= FEW


def _hits(asked: DataFrame, names: DataFrame, longest: int, sizes: list[int] | None) -> DataFrame:
    """The rows of ``asked`` without ``piece`` whose piece some name holds. Without wildcards hashes stand for pieces, so texts and pieces are not exchanged."""
    if sizes is None:
        return asked.join(_matched(asked, names, longest).select("piece").distinct(), "piece", "left_semi").drop("piece")
    held = _holding(names, sizes).select("_h", "_g")
    held = F.broadcast(held.distinct()) if _few(names, sizes) else held
    return asked.select("*", *_hashed("piece")).drop("piece").join(held, ["_h", "_g"], "left_semi").drop("_h", "_g")


def _first_pieces(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``text, size, piece`` of the texts of which a name holds a piece: the first of the longest ones. Sizes are found by halving."""
    longest = names.agg(F.max(F.char_length("name"))).first()[0] or 0
    most, wild = texts.agg(F.max(F.char_length("text")), F.bool_or(F.col("text").rlike(_WILD))).first()
    texts = checkpointed(texts.withColumns({"size": F.lit(0), "_t": F.monotonically_increasing_id()}))
    step = 1 << max((most or 0).bit_length() - 1, 0)

    def sizes(more: list[int]) -> list[int] | None:
        """The different sizes that are asked for; no more than the longest name has characters."""
        known = [r[0] for r in texts.select("size").distinct().collect()]
        return None if wild else sorted({size + m for size in known for m in more if 0 < size + m <= longest})

    while step:
        # the last halvings are asked at once
        more = [step] if step > AT_ONCE else list(range(1, 2 * step))
        asked, some = texts.withColumn("_more", F.explode(F.array(*map(F.lit, more)))), sizes(more)
        asked = _pieces(asked, "text", F.col("size") + F.col("_more"), "_t", "_more").drop("at")
        if some != []:  # else no name is so long
            hit = _hits(asked, names, longest, some).groupBy("_t").agg(F.max("_more").alias("_hit"))
            texts = checkpointed(texts.join(hit, "_t", "left").select("_t", "text", (F.col("size") + F.coalesce("_hit", F.lit(0))).alias("size")))
        step = step // 2 if step > AT_ONCE else 0
    first = _hits(_pieces(texts, "text", F.col("size"), "_t"), names, longest, sizes([0])).groupBy("_t").agg(F.min("at").alias("_at"))
    return checkpointed(texts.join(first, "_t").select("text", "size", F.substring(F.col("text"), F.col("_at"), F.col("size")).alias("piece")))


def _named(records: DataFrame, field: str) -> DataFrame:
    return records.where(F.col(field).isNotNull() & (match_key(F.col(field)) != "")).select("id", F.col(field).alias("field_value"), F.lower(field).alias("name"))


def longest_match(inputs: DataFrame, records: DataFrame, field: str) -> DataFrame:
    """``input_id, id, field_value, size``: the records that hold the first matching substring of each input.

    Substrings are tried from the longest and from the left; the first that any record holds, in any case, decides. In an input
    ``%`` stands for any run of characters and ``_`` for any one. Whatever its length, a text that has a match
    of some size has one of every smaller size, so sizes are found by halving: in each round every text asks for the substrings of one size, and names give
    their substrings of the sizes asked. The rows of a round grow with the characters of both sides, not with their pairs, and the rounds with the
    logarithm of the longest text. Equal names and equal inputs are looked up once.
    """
    named = _named(records, field)
    names = checkpointed(named.select("name").distinct())
    stripped = inputs.select("input_id", F.lower(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("text"))
    first = _first_pieces(stripped.where("text != ''").select("text").distinct(), names)
    met = _matched(first, names, names.agg(F.max(F.char_length("name"))).first()[0] or 0, None if not first.where(F.col("piece").rlike(_WILD)).isEmpty() else [r[0] for r in first.select("size").distinct().collect()])
    # a piece has its names, and a name its records, once, whatever the number of its texts
    found = met.distinct().join(named, "name").select("piece", "id", "field_value")
    return stripped.join(first, "text").join(found, "piece").select("input_id", "id", "field_value", "size")


def _stand_ins(records: DataFrame, fields: list[str]) -> tuple[DataFrame, bool]:
    """The records without those that have the same values as one of a lesser id, and whether each id has one record."""
    held = records.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("_rows"))
    least = checkpointed(held.groupBy("_rows").agg(F.min("id").alias("id")))
    return least.select("id", F.inline("_rows")), least.where(F.size("_rows") > 1).isEmpty()


def resolve(inputs: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """``input_id, id``: the record that each input names, or null.

    Of the fields those with the longest match count. Among their records, those whose key contains the
    input's or is contained in it are preferred; the shortest key, then the least, then the least id wins.
    Equal values are resolved once, and of records that agree in all fields only that of the least id can win.
    """
    records, single = _stand_ins(records, fields)
    values = checkpointed(inputs.select("value").distinct().withColumn("input_id", F.monotonically_increasing_id()))
    found = None
    for i, field in enumerate(fields):
        one = longest_match(values, records, field).withColumn("field", F.lit(i))
        found = one if found is None else found.unionByName(one)
    found = found.join(values.select("input_id", match_key(F.col("value")).alias("asked")), "input_id").withColumn("key", match_key(F.col("field_value")))
    close = (F.col("asked") != "") & (F.contains("key", "asked") | F.contains("asked", "key"))
    rows = found.withColumn("_close", close)
    order = lambda key: F.struct(F.char_length(key).alias("n"), F.col(key).alias("key"), F.col("id").alias("id"))
    if single and len(fields) == 1:
        # an id has one key, so the least of all rows is the answer, and tasks keep one row an input
        pick = rows.groupBy("input_id").agg(F.min(F.struct((~F.col("_close")).alias("far"), order("key").alias("p")))["p"].alias("p"))
    else:
        per_input, per_field = Window.partitionBy("input_id"), Window.partitionBy("input_id", "field")
        rows = rows.withColumn("_best", F.max("size").over(per_input)).where("size = _best")
        rows = rows.withColumn("_any", F.bool_or("_close").over(per_field)).where("_close or not _any")
        one_per_id = rows.groupBy("input_id", "id").agg(F.min(F.struct("field", "key")).alias("m"))
        pick = one_per_id.groupBy("input_id").agg(F.min(order("m.key")).alias("p"))
    picked = values.join(pick, "input_id").select(F.col("value").alias("_value"), F.col("p.id").alias("id"))
    return inputs.join(picked, F.col("value") == F.col("_value"), "left").select("input_id", "id")


def only_one(values: DataFrame, column: str) -> str:
    """The single distinct value of a column; an error if there is none or more."""
    found = [r[0] for r in values.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{column} has {'no value' if not found else 'several values'}")
    return found[0]
