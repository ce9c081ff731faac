"""Chat formatting with Spark expressions only: sort, merge, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, require

#: Marks of the template. Each begins with ``<`` or ``[``, which never stand bare in a text.
BEGIN, NAMED, NEXT, END, CLOSE = "[INST:", "]", "<turn>", "[/INST]", "</s>"
#: The escape and what it guards; the escape itself comes first.
ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"), ("]", "~3"))


def escape(text: Column) -> Column:
    """No mark can occur in the result; ``unescape`` gives the text back."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _before(lengths: Column) -> Column:
    """For each value the sum of all before it. Steps of doubling width add up, so that the work is n log n for n values."""
    n = F.size(lengths)
    doubling = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    widths = F.when(n > 1, doubling).otherwise(F.array().cast("array<int>"))
    shifted = F.transform(lengths, lambda _, i: F.coalesce(F.get(lengths, i - 1), F.lit(0)).cast("long"))
    return F.aggregate(widths, shifted, lambda sums, w: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - w), F.lit(0).cast("long"))))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id, formatted, loss_spans``.

    ``turns(conv_id, turn, role, text)``: the turns of a conversation are sorted by ``turn`` (a null
    turn first; ties by role and then text, so that repeated rows stand side by side), a null role or
    text counts as empty. Adjacent turns of one role are merged into one block

        [INST:role]text<turn>text[/INST]

    and ``</s>`` ends the conversation. ``~``, ``[``, ``<`` and ``]`` inside roles and texts are
    escaped, so that no text can forge a mark and all turns can be read back with ``read_turns``.
    ``loss_spans`` are the ``(start, length)`` in code points of each text of ``loss_role``, from 0.
    Rows without a conversation id are grouped under the null id; an empty table gives no rows; other
    columns are ignored. All turns of a conversation become one value, as the output asks for it; the work is
    linear in its text, and n log n in the number of its turns.
    """
    require(turns, ["conv_id", "turn", "role", "text"])
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    coded = F.transform("turns", lambda t: F.struct((t["role"] == loss_role).alias("loss"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    found = found.select("conv_id", coded.alias("turns"))

    def piece(turns: Column, t: Column, i: Column) -> Column:
        other = lambda j: F.coalesce(F.get(turns, j)["role"] != t["role"], F.lit(True))  # noqa: E731 - also where no turn stands
        head = F.when(other(i - 1), F.concat(F.lit(BEGIN), t["role"], F.lit(NAMED))).otherwise(NEXT)
        tail = F.when(other(i + 1), END).otherwise("")
        return F.struct(t["loss"].alias("loss"), head.alias("head"), t["text"].alias("text"), tail.alias("tail"))

    found = found.select("conv_id", let(F.col("turns"), lambda turns: F.transform(turns, lambda t, i: piece(turns, t, i))).alias("pieces"))
    n = F.char_length
    lengths = F.transform("pieces", lambda p: n(p["head"]) + n(p["text"]) + n(p["tail"]))

    def spans(at: Column) -> Column:
        span = lambda p, i: F.when(p["loss"], F.struct((F.get(at, i) + n(p["head"])).alias("start"), n(p["text"]).cast("long").alias("length")))
        return F.filter(F.transform("pieces", span), lambda s: s.isNotNull())

    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return found.select("conv_id", F.concat(formatted, F.lit(CLOSE)).alias("formatted"), let(let(lengths, _before), spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, as an array of ``(role, text)`` in order."""

    def turns_of(block: Column) -> Column:
        def read(cut: Column) -> Column:
            role, texts = F.substring(block, F.lit(1), cut - 1), F.substring(block, cut + 1, F.char_length(block))
            return F.transform(
                F.split(texts, NEXT), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text"))
            )

        return let(F.instr(block, NAMED), read)

    inner = F.substring(formatted, F.lit(1), F.char_length(formatted) - len(CLOSE))
    blocks = F.filter(F.split(inner, r"\[INST:"), lambda b: b != "")
    return F.flatten(
        F.transform(blocks, lambda b: turns_of(F.substring(b, F.lit(1), F.char_length(b) - len(END))))
    )


#: Code points of the slices that a formatted text is read in; finding a place in a slice takes time in proportion to it.
_SLICE = 512


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between its parts."""

    def read(slices: Column) -> Column:
        def part(s: Column) -> Column:
            first = F.floor(s["start"] / _SLICE).cast("int")
            inside = (s["start"] - first * _SLICE).cast("int")
            some = F.slice(slices, first + 1, F.floor((inside + s["length"]) / _SLICE).cast("int") + 1)
            return unescape(F.substring(F.array_join(some, ""), inside + 1, s["length"].cast("int")))

        return F.array_join(F.transform(spans, part), "")

    return let(F.regexp_extract_all(formatted, F.lit(rf"(?s)(.{{1,{_SLICE}}})"), F.lit(1)), read)
