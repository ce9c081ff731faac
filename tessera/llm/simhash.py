"""SimHash near-duplicates, found by deletion-variant signatures of their fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, components, drop, is_empty, materialize, null_id, require, screen, split_words, with_id

BITS, SHINGLE, SEED = 64, 4, 42
#: Differing bits up to which two fingerprints link.
MOST = 4
#: Members of a key outside its largest component up to which they are compared with all members; those of more crowded keys are keyed again.
CROWD = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit number: of the hashes of its shingles, each bit that more than half have.

    A text of fewer words is one shingle; one without words has the fingerprint zero.
    """
    ones, n, held = np.zeros(BITS, dtype=np.int64), 0, []
    for words in split_words(text):
        held += words
        if len(held) >= shingle:
            hashes = _hashes(held, shingle)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
            held = held[len(held) - shingle + 1 :]
    if not n and held:
        hashes = _hashes(held, len(held))
        ones, n = np.unpackbits(hashes.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(words) - size + 1)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row: the fingerprint of its whole text, A-Z lower-cased. A null text is empty."""
    require(docs, ["doc_id", "text"])
    if shingle < 1:
        raise ValueError("a shingle has one word at least")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", NO_ID]].assign(fp=[fingerprint(t, shingle) for t in batch["text"]])

    texts = with_id(docs, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return null_id(texts.mapInPandas(run, f"doc_id long, {NO_ID} boolean, fp long"))


def simhash_components(docs: DataFrame, most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row: 16 hexadecimal digits, and the smallest id that links reach.

    Fingerprints link if they differ by at most ``most`` bits. Equal ones are one class. A fingerprint is cut into just so many
    segments that of two that link one segment differs by one bit at most: three for four bits. Every class is filed under its segments
    and under each without one of its bits, 67 keys; classes that share a segment, or differ in the bit left out, are verified,
    two alone at once. Of more, links are found in two steps. First each class meets one of its key, drawn by hash, which is linear and joins dense groups. Then, of
    each key whose classes are not in one component yet, those outside its largest component meet all others. A key
    with more than ``CROWD`` of them is filed again by its other bits in the same way, so that neither step grows with the
    square of a key. No link between two components is lost.

    A null text counts as empty, and texts without words have the fingerprint zero, which links like any other. A row
    without id has a result and names no component, unless all rows in it lack an id, when its component is null. Repeated
    rows each have a result. Other columns are ignored. An empty table gives an empty table.
    """
    if not 0 <= most < BITS:
        raise ValueError("most lies between 0 and 63")
    prints = materialize(fingerprints(docs, shingle), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = _linked(classes.select("fp"), most)
    named = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = materialize(named.join(least, "component").select("fp", "component_id"), "answer")
    drop(classes, linked)
    return prints.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _cut(places: list[int], most: int) -> list[list[int]]:
    """The bit places in so few runs that two prints with at most so many differing bits differ by one at most in some run."""
    n = min(most // 2 + 1, len(places))
    return [places[len(places) * i // n : len(places) * (i + 1) // n] for i in range(n)]


def _masks(places: list[int], most: int) -> list[tuple[int, int, int]]:
    """``(run, place, mask)`` of each segment as it is, with the place -1, and of its deletion variants: without the bit of a place."""
    out = []
    for i, run in enumerate(_cut(places, most)):
        whole = sum(1 << b for b in run)
        out += [(i, -1, _signed(whole)), *((i, w, _signed(whole ^ 1 << w)) for w in run)]
    return out


def _finer_masks(most: int) -> list[tuple[int, int, int]]:
    """``(run, place, mask)``: for each segment those of all bits outside it."""
    out = []
    for i, run in enumerate(_cut(list(range(BITS)), most)):
        others = [b for b in range(BITS) if b not in run]
        out += [(i, place, mask) for _, place, mask in (_masks(others, most) if others else [(0, -1, 0)])]
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bit(place: str) -> Column:
    """The bit of a print at a place; 0 at the place -1."""
    return F.when(F.col(place) >= 0, F.expr(f"cast(shiftright(fp, {place}) & 1L as int)")).otherwise(0)


def _keys(prints: DataFrame, most: int) -> DataFrame:
    """``fp, run, key, side, split``: the keys of each print, one for each segment as it is and one for each variant without a bit.

    Two prints that have a segment in common meet there. In a key without a bit only those that differ in it are asked of each
    other: ``split`` says so, and ``side`` is the bit. So a pair meets once a segment at most.
    """
    variants = F.array(*(F.struct(F.lit(i).alias("run"), F.lit(w).alias("place"), F.lit(m).cast("long").alias("mask")) for i, w, m in _masks(list(range(BITS)), most)))
    rows = prints.select("fp", F.inline(variants))
    return rows.select("fp", "run", F.xxhash64("run", "place", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), _bit("place").alias("side"), (F.col("place") >= 0).alias("split"))


def _finer_keys(crowded: DataFrame, most: int) -> DataFrame:
    """The rows of crowded keys under keys that also hold a segment, or a variant, of the bits outside their own segment.

    Where both keys are split, partners differ in both bits, so the parity of the two goes into the key and one bit is the side.
    """
    finer = crowded.sparkSession.createDataFrame(_finer_masks(most), "run int, place int, mask long")
    rows = crowded.join(F.broadcast(finer), "run").withColumn("bit", _bit("place"))
    both = F.col("split") & (F.col("place") >= 0)
    key = F.xxhash64("key", "place", F.col("fp").bitwiseAND(F.col("mask")), F.when(both, F.col("side").bitwiseXOR(F.col("bit"))))
    return rows.select("fp", "run", key.alias("key"), F.when(F.col("split"), F.col("side")).otherwise(F.col("bit")).alias("side"), (F.col("split") | (F.col("place") >= 0)).alias("split"))


def _linked(prints: DataFrame, most: int) -> DataFrame:
    """``fp, component`` of the prints that have links; the table is written."""
    spark = prints.sparkSession
    edges = [spark.createDataFrame([], "src long, dst long")]
    labels = materialize(spark.createDataFrame([], "fp long, component long"), "labels")
    if not most:
        return labels
    keys = _keys(prints, most)
    for last in (False, True):
        members, near = _filed(keys, most)
        edges.append(near)
        salt, before = 0, None
        while True:
            edges.append(_stars(members, most, salt))
            drop(labels)
            labels = _label(edges)
            opened = _open(members, labels)
            asked = opened.select("key", "n", "others").distinct().agg(F.sum(F.col("n") * F.least("others", F.lit(CROWD)))).first()[0] or 0
            if asked <= 8 * members.count() or (before is not None and 3 * asked > 2 * before):
                break
            drop(opened)
            salt, before = salt + 1, asked
        few = opened if last else opened.where(F.col("others") <= CROWD)
        crowded = opened.where(F.col("others") > CROWD)
        done = last or is_empty(crowded)
        edges.append(materialize(_pairs(few, most), "pairs"))
        if done:
            if not is_empty(edges[-1]):
                drop(labels)
                labels = _label(edges)
            drop(members, opened, *edges[1:])
            return labels
        keys = materialize(_finer_keys(crowded, most), "finer")
        drop(members, opened)
    return labels


def _filed(keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys under which three classes or more have partners, and the links of keys of two.

    A split key has partners if it holds both sides. Classes that meet by chance do so in twos for the most part; those are
    verified where they are counted and go no further.
    """
    counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"), (F.any_value("split") & (F.min("side") == F.max("side"))).alias("alone"))
    counted = materialize(counted.where(~F.col("alone") & ((F.col("n") > 2) | ((F.col("n") == 2) & (_far("src", "dst") <= most)))), "keys")
    crowds = materialize(counted.where("n > 2").select("key"), "crowds")
    near = materialize(counted.where("n = 2").select("src", "dst").distinct(), "near")
    members = materialize(screen(keys, "key", crowds).join(crowds, "key", "left_semi"), "members")
    drop(counted, crowds)
    return members, near


def _stars(members: DataFrame, most: int, salt: int) -> DataFrame:
    """Edges from the classes of a key to the one of them that a hash draws, as far as they link."""
    drawn = members.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp", "key", F.lit(salt))).alias("pivot"))
    near = members.join(materialize(drawn, "pivots"), "key").where((F.col("fp") != F.col("pivot")) & (_far("fp", "pivot") <= most))
    return materialize(near.select(F.least("fp", "pivot").alias("src"), F.greatest("fp", "pivot").alias("dst")).distinct(), "stars")


def _label(edges: list[DataFrame]) -> DataFrame:
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.unionByName(e)
    return materialize(components(whole).select(F.col("node").alias("fp"), "component"), "labels")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys whose classes are in several components: the members with ``component, main, n, others``.

    ``main`` is the component with most of the ``n`` classes of the key, ``others`` the number of classes outside it.
    """
    told = members.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    told = materialize(told, "told")
    parts = told.groupBy("key", "component").agg(F.count("*").alias("own"))
    keys = parts.groupBy("key").agg(F.max_by("component", F.struct("own", "component")).alias("main"), F.max("own").alias("most"), F.sum("own").alias("n"))
    keys = keys.where(F.col("n") > F.col("most")).select("key", "main", "n", (F.col("n") - F.col("most")).alias("others"))
    out = materialize(told.join(keys, "key"), "open")
    drop(told)
    return out


def _pairs(opened: DataFrame, most: int) -> DataFrame:
    """Links between the classes outside a key's largest component and their partners of other components."""
    partner = F.when(F.col("split"), 1 - F.col("side")).otherwise(F.col("side"))
    outside = opened.where(F.col("component") != F.col("main")).select("key", partner.alias("side"), F.col("fp").alias("a"), F.col("component").alias("ca"))
    inside = opened.select("key", "side", F.col("fp").alias("b"), F.col("component").alias("cb"))
    near = outside.join(inside, ["key", "side"]).where((F.col("ca") != F.col("cb")) & (_far("a", "b") <= most))
    return near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
