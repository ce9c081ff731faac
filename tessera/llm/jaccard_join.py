"""N-gram Jaccard join with a token-group matrix: exact links between texts, reported as components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, components, drop, is_empty, materialize, null_id, require, screen, with_id, without
from .wordhash import hash_words, mix, portions, window_hashes

SHINGLE = 5
#: Similarity at which two documents link, as a percentage, so that the test is in whole numbers.
PERCENT = 80
#: Zones of set sizes ``(least, below, share)``: a set of that size enters the matrix with the tokens whose hash is in
#: the lowest share of all hashes. Neighbouring zones overlap by a quarter, so that sets that can link meet in one.
ZONES = ((1, 200, 1.0), (160, 1000, 0.4), (800, 1 << 62, 0.32))
#: Tokens of a group's members, and of the sets asked of them, that a task holds at once; what is larger is dealt out in blocks.
TASK_TOKENS = 250_000
#: Classes that a task remembers in order not to send copies twice.
REMEMBERED = 500_000
_SHORT = np.uint64(0x7C15F39CC0605CED)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: five words, or all words of a shorter one."""
    words, at = hash_words(texts)
    fives = window_hashes(words, SHINGLE) if len(words) >= SHINGLE else words
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(fives[a : b - SHINGLE + 1])
        elif b > a:
            h = np.array([_SHORT])
            for i in range(a, b):
                h = mix(h * np.uint64(3) + words[i : i + 1])
            yield h
        else:
            yield np.empty(0, dtype=np.uint64)


#: The lowest bits of a class number are free for the number of a zone.
ZONE_BITS = 2


def _class_of(tokens: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    total = np.append(mix(tokens), np.uint64(len(tokens) * 0x9E3779B97F4A7C15 % (1 << 64))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total).view(np.int64)[0]) >> ZONE_BITS << ZONE_BITS


def _prefix_size(n: int, percent: int) -> int:
    """Of any so many tokens of a set of n, one at least is in every set that links with it."""
    return n - (percent * n + 99) // 100 + 1


def _lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def _zones(tokens: np.ndarray, percent: int, widen: float) -> Iterator[tuple[int, np.ndarray]]:
    """The zones of a set, each with the tokens that it enters the matrix with.

    Below 80 percent the zones would not overlap enough, so there is one with all tokens.
    """
    n = len(tokens)
    for z, (least, below, share) in enumerate(ZONES if percent >= 80 else ((1, 1 << 62, 1.0),)):
        if least <= n < below:
            share = min(1.0, share * widen)
            yield z, tokens if share == 1.0 else tokens[: np.searchsorted(tokens, np.uint64(int(share * (1 << 64))))]


def _sets(docs: DataFrame, percent: int, widen: float) -> DataFrame:
    """``doc_id, n, class, t, wild``: size and class of each set and its tokens by zone, of which -1 means that it is not in it.

    A set is wild if it has too few tokens in a zone to promise a meeting.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, no_id, texts = batch["doc_id"].to_numpy(), batch[NO_ID].to_numpy(), [_lowered(t) for t in batch["text"]]
            for a, b in portions(texts):
                n, own, held, wild = [], [], [], []
                for tokens in shingle_sets(texts[a:b]):
                    t = [-1] * len(ZONES)
                    for z, some in _zones(tokens, percent, widen):
                        t[z] = len(some)
                    n.append(len(tokens))
                    own.append(_class_of(tokens) if len(tokens) else None)
                    held.append(t)
                    wild.append(any(0 <= x < _prefix_size(len(tokens), percent) for x in t))
                # whole numbers with nulls, which a plain column would turn into floats and round
                exact = pd.array(own, dtype="Int64")
                yield pd.DataFrame({"doc_id": ids[a:b], NO_ID: no_id[a:b], "n": n, "class": exact, "t": held, "wild": wild})

    return null_id(with_id(docs, "text").mapInPandas(run, f"doc_id long, {NO_ID} boolean, n long, class long, t array<int>, wild boolean"))


def _matrix(docs: DataFrame, percent: int, widen: float) -> DataFrame:
    """``key, token``: the tokens of each class by zone, once a task; the key holds class and zone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            texts = [_lowered(t) for t in batch["text"]]
            for a, b in portions(texts):
                keys, parts = [], []
                for tokens in shingle_sets(texts[a:b]):
                    own = _class_of(tokens) if len(tokens) else None
                    if own is None or own in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(own)
                    for z, some in _zones(tokens, percent, widen):
                        keys.append(np.full(len(some), own | z, dtype=np.int64))
                        parts.append(mix(some + np.uint64(z)).view(np.int64))
                if keys:
                    yield pd.DataFrame({"key": np.concatenate(keys), "token": np.concatenate(parts)})

    return docs.select("text").mapInPandas(run, "key long, token long")


def _postings(docs: DataFrame, sets: DataFrame, percent: int, widen: float) -> DataFrame:
    """``token, at, class, rep, n, weight``: the prefix of each set in each zone, which is made of its rarest tokens.

    Sets that link share a token of both prefixes. ``at`` counts the tokens of the set in the zone that are rarer, ``rep`` is a
    document of the class, ``n`` its size, and ``weight`` tells how common
    its tokens are: of a family of near copies the set that most of them derive from weighs most.
    """
    one = sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("t").alias("t"))
    sized = one.where("rep is not null").select("class", "rep", "n", F.posexplode("t").alias("z", "t")).where("t >= 0")
    sized = sized.withColumn("key", F.col("class").bitwiseOR(F.col("z").cast("long"))).drop("z")
    matrix = materialize(_matrix(docs, percent, widen), "matrix")
    common = materialize(matrix.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1"), "common-tokens")
    shared = screen(matrix, "token", common).join(common, "token")
    ranked = shared.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("freq", "token"))).alias("some")).join(sized, "key")
    weight = F.aggregate("some", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["freq"]) / F.col("n")
    prefix = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (t - size(some))")
    rarest = F.slice("some", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))
    short = ranked.select("class", "rep", "n", weight.alias("weight"), (F.col("t") - F.size("some")).alias("unique"), rarest.alias("rarest"))
    postings = short.select("class", "rep", "n", "weight", "unique", F.posexplode("rarest").alias("nth", "s"))
    postings = materialize(postings.select("s.token", (F.col("unique") + F.col("nth")).alias("at"), "class", "rep", "n", "weight"), "postings")
    drop(matrix, common)
    return postings


def _reaches(n: str, at: str, other: str, percent: int) -> Column:
    """Whether a set of ``n`` tokens, of which ``at`` are in no set of ``other`` tokens that it is compared with, can still link with one.

    Where the first common token of two sets stands behind ``at`` others in one of them, their overlap is ``n - at`` at most.
    """
    return (100 + percent) * (F.col(n) - F.col(at)) >= percent * (F.col(n) + F.col(other))


def _families(docs: DataFrame, postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """A first round of links, which partitions similar sets into groups: ``src, dst``, and the tokens that several classes hold.

    Of the classes that share a prefix token the heaviest is the token's pivot. Each class is compared with one pivot: that of
    most of its tokens.
    """
    best = postings.groupBy("token").agg(F.max(F.struct("weight", "class", "rep", "n", "at")).alias("p"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    pivots = best.where("lo != hi").select("token", F.col("p.class").alias("group"), F.col("p.rep").alias("group_rep"), F.col("p.n").alias("group_n"), F.col("p.at").alias("group_at"))
    pivots = materialize(pivots, "pivots")
    fits = _reaches("n", "at", "group_n", percent) & _reaches("group_n", "group_at", "n", percent)
    votes = postings.join(pivots, "token").where((F.col("class") != F.col("group")) & fits)
    votes = votes.groupBy("class", "rep", "n", "group", "group_rep", "group_n").agg(F.count("*").alias("votes"))
    choice = votes.groupBy("class", "rep", "n").agg(F.max(F.struct("votes", "group", "group_rep", "group_n")).alias("c"))
    chosen = materialize(choice.select("class", "rep", "n", "c.group", "c.group_rep", "c.group_n"), "chosen-pivots")
    members = chosen.select("group", F.col("group").alias("class"), F.col("group_rep").alias("rep"), F.col("group_n").alias("n")).distinct()
    links = materialize(_opened(docs, chosen.select("group", "class", "rep", "n"), members, percent), "family-links")
    drop(chosen)
    return links, pivots


def _others(docs: DataFrame, postings: DataFrame, pivots: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links between different groups: ``src, dst``. What the first round has not linked is a group of its own.

    Two groups that share a prefix token may link. The classes of the smaller one are asked of the members of the larger one; only
    those with a shared token and of sizes that allow it take part.
    """
    sized = families.groupBy("component").agg(F.count("*").alias("members"))
    own = families.join(sized, "component").select(F.col("node").alias("class"), "component", "members")
    placed = postings.select("token", "at", "class", "rep", "n").join(pivots.select("token"), "token", "left_semi").join(own, "class", "left")
    placed = placed.select("token", "at", "class", "rep", "n", F.coalesce("component", "class").alias("group"), F.coalesce("members", F.lit(1)).alias("members"))
    placed = materialize(placed, "located-postings")
    # of a group's members with a token: the least size, and how far the best of them reaches as in `_reaches`
    far = F.max(100 * F.col("n") - (100 + percent) * F.col("at"))
    spread = placed.groupBy("token", "group", "members").agg(F.min("n").alias("lo"), far.alias("far"))
    several = placed.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a != b").select("token")
    targets = spread.join(several, "token", "left_semi")
    targets = materialize(targets.select("token", F.col("group").alias("other"), F.col("members").alias("other_members"), "lo", "far"), "token-groups")
    smaller = F.struct("members", "group") < F.struct(F.col("other_members").alias("members"), F.col("other").alias("group"))
    fits = _reaches("n", "at", "lo", percent) & (F.col("far") >= percent * F.col("n"))
    met = materialize(placed.join(targets, "token").where(smaller & fits).select("token", "class", "rep", "n", "other"), "asked-tokens")
    asked = met.select(F.col("other").alias("group"), "class", "rep", "n").distinct()
    wanted = met.select("token", F.col("other").alias("group")).distinct()
    members = placed.join(wanted, ["token", "group"]).select("group", "class", "rep", "n").distinct()
    links = materialize(_opened(docs, asked, members, percent), "other-links")
    drop(placed, targets, met)
    return links


def link(members: list[np.ndarray], asked: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each asked set the number of a member that it links with, or -1.

    The members are put into groups that share their least token, and a matrix keeps which tokens each group's union holds. The
    overlap of an asked set with a union bounds that with every member of the group, so a group is opened only if it
    reaches ``percent`` of the set.
    """
    size = np.array([len(m) for m in members])
    whole, counts_at = np.concatenate(members), np.append(0, np.cumsum(size))
    tokens, ids = np.unique(whole, return_inverse=True)
    rows = [ids[a:b] for a, b in zip(counts_at[:-1], counts_at[1:], strict=True)]
    of_group: dict[int, list[int]] = {}
    for i, row in enumerate(rows):
        of_group.setdefault(int(row[0]), []).append(i)
    groups = [np.array(m) for m in of_group.values()]
    unions = [np.unique(np.concatenate([rows[i] for i in m])) for m in groups]
    held, held_at = np.concatenate(unions), np.cumsum([0, *(len(u) for u in unions)])[:-1]
    inner = [(np.concatenate([rows[i] for i in m]), np.cumsum([0, *(len(rows[i]) for i in m)])[:-1]) for m in groups]
    low, high = np.array([size[m].min() for m in groups]), np.array([size[m].max() for m in groups])
    mark, found = np.zeros(len(tokens), dtype=np.int32), []
    for own in asked:
        n, hit = len(own), -1
        spot = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        here = spot[tokens[spot] == own]
        if 100 * len(here) >= percent * n:
            mark[here] = 1
            bound = np.add.reduceat(mark[held], held_at)
            fits = (100 * bound >= percent * n) & (percent * low <= 100 * n) & (100 * high >= percent * n)
            for g in np.flatnonzero(fits):
                flat, at = inner[g]
                both = np.add.reduceat(mark[flat], at)
                linked = np.flatnonzero(100 * both >= percent * (n + size[groups[g]] - both))
                if len(linked):
                    hit = int(groups[g][linked[0]])
                    break
            mark[here] = 0
        found.append(hit)
    return found


def _opened(docs: DataFrame, asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``src, dst``: for each ``asked(group, class, rep, n)`` a member of that group in each block with which it links, if any.

    All members of a group are linked with each other already, so one link a block is enough. Members beyond ``TASK_TOKENS`` are
    dealt out in blocks and what is asked of them in chunks, and small groups share a task, so that every task has about as much to do. One
    text stands for each class.
    """
    load = lambda df, name: df.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / TASK_TOKENS)).cast("int").alias(name))
    sizes = materialize(load(members, "blocks").join(load(asked, "chunks"), "group"), "group-sizes")
    own = lambda parts: F.pmod(F.xxhash64("class"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    placed = members.join(sizes, "group").select("group", "class", "rep", "n", own("blocks").alias("b"), each("chunks").alias("c"), F.lit(False).alias("asks"))
    asking = asked.join(sizes, "group").select("group", "class", "rep", "n", each("blocks").alias("b"), own("chunks").alias("c"), F.lit(True).alias("asks"))
    placed = materialize(placed.unionByName(asking), "opened-groups")
    tasks = max(1, -(-(placed.agg(F.sum("n")).first()[0] or 0) // TASK_TOKENS))
    task = F.pmod(F.xxhash64("group", "b", "c"), F.lit(tasks)).alias("task")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    met = screen(texts, "rep", placed).join(placed.select("group", "class", "rep", "b", "c", "asks", task), "rep")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, np.ndarray] = {}
        own, which = frame["class"].to_numpy(), [_lowered(t) for t in frame["text"]]
        for name, tokens in zip(own.tolist(), shingle_sets(which), strict=True):
            if len(tokens) and name not in held and _class_of(tokens) == name:
                held[name] = tokens
        usable = np.array([name in held for name in own.tolist()])
        edges: list[tuple[int, int]] = []
        for _, part in frame[["group", "class", "b", "c", "asks"]][usable].drop_duplicates().groupby(["group", "b", "c"]):
            names, asking = part["class"][~part["asks"]].tolist(), part["class"][part["asks"]].tolist()
            if names and asking:
                hits = link([held[m] for m in names], [held[q] for q in asking], percent)
                edges += [(q, names[i]) for q, i in zip(asking, hits, strict=True) if i >= 0]
        return pd.DataFrame(edges, columns=["src", "dst"], dtype="int64")

    return met.groupBy("task").applyInPandas(run, "src long, dst long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the components of documents that link.

    A document's set holds its distinct five-word shingles (A-Z in lower case; words are the runs outside
    \\x20 and \\x09-\\x0D), or the whole sequence if it has fewer words. Two documents link if
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id that can be
    reached over links. No link between different texts is lost and none is approximate but for
    collisions of 64-bit hashes.

    Equal sets form one class and are compared once. A matrix of tokens and classes, restricted to each
    set's rarest tokens, tells which can link. A first round compares each class with one pivot and so partitions
    similar documents into groups. After it only classes of different groups are of interest: a class is asked of a group
    with which it shares a token that is rare enough in both, whose token union bounds the overlap (``link``), and only groups that qualify are
    opened. Tokens are counted by partial aggregation, all joins have a plain exchange on either side, and groups are dealt out in
    blocks of ``TASK_TOKENS``, so no task grows with the size of a group or the frequency of a token. What grows is the number
    of pairs of a class and a group that share a rare token and do not link.

    Null or empty texts, or texts without a word, have size 0 and are linked with nothing; their
    component is their own id. Rows without an id get size and a null component unless a row with an
    id has the same set. Rows that share an id are judged each by its own text; of classes of equal weight the greater number is the
    pivot, which does not change the result. Long texts are read whole. An empty table gives no rows; other columns are ignored.
    """
    require(docs, ["doc_id", "text"])
    widen = 1.0
    while True:
        sets = materialize(_sets(docs, percent, widen), "sets")
        if widen >= 8 or is_empty(sets.where("wild")):
            break
        widen *= 2  # some set kept too few tokens by chance: keep more of all; at 1.0 none can
    postings = _postings(docs, sets, percent, widen)
    first, pivots = _families(docs, postings, percent)
    families = materialize(components(first, "families"), "families")
    second = _others(docs, postings, pivots, families, percent)
    joined = materialize(components(first.unionByName(second), "class-components"), "class-components")
    drop(postings, pivots, families)
    rows = sets.select("doc_id", "n", "class").join(joined.withColumnRenamed("node", "class"), "class", "left")
    rows = materialize(rows.select("doc_id", "n", F.coalesce("component", "class").alias("component")), "judged-sets")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(materialize(least, "component-ids"), "component", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component: that whose id names it. Texts without a word and rows without an id stay."""
    found = jaccard_components(docs, percent).where("doc_id != component_id").select("doc_id").distinct()
    return without(docs, "doc_id", materialize(found, "copies"))
