"""Recompression of word sequences: rounds that name runs and pairs, so that equal stretches get equal symbols.

A name is a hash of what it stands for: of a run's symbol and length, or of the two names of a pair. So it is the same wherever it is made, and
the names of a round are global without an exchange.
"""

from __future__ import annotations

import numpy as np

from .wordhash import mix

#: Rounds of naming pairs; each joins about a quarter of all neighbours.
ROUNDS = 3
_RUN, _PAIR = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xDA942042E4DD58B5)


class Level:
    """The symbols of one level over a batch of documents: name, first word, and the words that decide the name.

    ``low``..``high`` is the range of words on which it depends that just this symbol stands here: two
    places that agree on those words have the same symbol. ``low`` or ``high`` lies outside of the
    document if its edge takes part, for then no stretch of words decides it.
    """

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray):
        self.name, self.low, self.high, self.doc = name, low, high, doc


def _joined(doc: np.ndarray) -> np.ndarray:
    """Whether each symbol has a right neighbour in its document; the last one has none."""
    return np.append(doc[:-1] == doc[1:], False)


def name_runs(level: Level) -> Level:
    """Names each longest run of one symbol by the symbol and its length. What ends a run decides it too."""
    near = _joined(level.doc)
    same = near & np.append(level.name[:-1] == level.name[1:], False)
    first = np.flatnonzero(~np.append(False, same[:-1]))
    last = np.append(first[1:], len(level.name)) - 1
    count = (last - first + 1).astype(np.uint64)
    name = np.where(count > 1, mix(level.name[first] * _RUN + count), level.name[first])
    low = np.where(np.append(False, near[:-1])[first], level.low[first - 1], level.low[first] - 1)
    high = np.where(near[last], level.high[np.minimum(last + 1, len(level.high) - 1)], level.high[last] + 1)
    return Level(name, low, high, level.doc[first])


def name_pairs(level: Level, round_: int) -> Level:
    """Parts all symbols in left and right ones by a bit of their hash and names each pair of a left and a right one.

    A pair depends on its two symbols alone, and a symbol that stays single on the one neighbour that it
    might have been paired with.
    """
    n = len(level.name)
    left = (mix(level.name + np.uint64(round_ + 1)) & np.uint64(1)) == 0
    near = _joined(level.doc)
    pair = np.append(near[:-1] & left[:-1] & ~left[1:], False)
    first = np.flatnonzero(~np.append(False, pair[:-1]))
    two = pair[first]
    right = np.minimum(first + 1, n - 1)
    name = np.where(two, mix(level.name[first] * _PAIR + level.name[right] * _RUN + np.uint64(round_)), level.name[first])
    low, high = level.low[first], np.where(two, level.high[right], level.high[first])
    alone_left, alone_right = ~two & left[first], ~two & ~left[first]
    after = np.where(near[first], np.maximum(high, level.high[right]), high + 1)
    before_near = np.append(False, near[:-1])[first]
    before = np.where(before_near, np.minimum(low, level.low[first - 1]), low - 1)
    high = np.where(alone_left, after, high)
    low = np.where(alone_right, before, low)
    return Level(name, low, high, level.doc[first])


def name_neighbours(level: Level) -> Level:
    """Names every two neighbouring symbols of a document, without parting them in left and right ones: the last round.

    Its symbols overlap. Each is decided by what decides the two.
    """
    two = np.flatnonzero(_joined(level.doc))
    name = mix(level.name[two] * _PAIR + level.name[two + 1] * _RUN + np.uint64(1 << 32))
    low, high = np.minimum(level.low[two], level.low[two + 1]), np.maximum(level.high[two], level.high[two + 1])
    return Level(name, low, high, level.doc[two])


def levels(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words themselves, then the symbols after the run round, after each pair round and after the last one."""
    at = np.arange(len(words))
    found = [Level(words, at, at, doc)]
    if len(words):
        found.append(name_runs(found[0]))
        for r in range(rounds):
            found.append(name_pairs(found[-1], r))
        found.append(name_neighbours(found[-1]))
    return found


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class Spans:
    """Hashes of any ranges of words by sums of powers, equal for equal ranges wherever they stand."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, _BACK, dtype=np.uint64)))
        up = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, dtype=np.uint64)))[:n]
        self.sums = np.append(np.uint64(0), np.cumsum(words * up, dtype=np.uint64))

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64) * _RUN)


def anchors(words: np.ndarray, doc: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``size`` words: whether it lies in one document, its symbol and the symbol's first deciding word.

    A window's symbol is the name of one of the highest level of which its own words decide any: the least hashed name, and of
    equal ones the first. Equal windows thus have equal symbols at equal places in them, wherever they stand. A window that
    decides no symbol of the upper levels, such as one within a long run, takes a word.
    """
    n = len(words)
    begin, end = np.searchsorted(doc, doc, side="left"), np.searchsorted(doc, doc, side="right")
    whole = np.arange(n) + size <= end
    name, place = np.zeros(n, dtype=np.uint64), np.full(n, -1, dtype=np.int64)
    open_ = whole.copy()
    chain = levels(words, doc, rounds)
    for level in (chain[-1], chain[-2], chain[0]):
        if not open_.any():
            break
        at = np.minimum(np.maximum(level.low, 0), n - 1)
        at_begin, at_end = np.where(level.low < 0, 0, begin[at]), end[at]
        same = (doc[at] == level.doc) & (level.low >= 0) & (level.high < at_end)
        first, last = np.maximum(level.high - size + 1, at_begin), np.minimum(level.low, at_end - size)
        good = np.flatnonzero(same & (first <= last))
        if level is not chain[-1]:  # only for windows that no higher symbol serves
            reach = np.cumsum(np.append(0, open_))
            good = good[reach[last[good] + 1] > reach[first[good]]]
        mark = mix(level.name[good])
        length = last[good] - first[good] + 1
        owner = np.repeat(np.arange(len(good)), length)
        window = np.repeat(first[good] - np.cumsum(length) + length, length) + np.arange(length.sum())
        use = open_[window]
        owner, window = owner[use], window[use]
        least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, window, mark[owner])
        hit = mark[owner] == least[window]
        owner, window = owner[hit], window[hit]
        spot = np.full(n, n, dtype=np.int64)
        np.minimum.at(spot, window, level.low[good][owner])
        done = np.flatnonzero(spot < n)
        name[done], place[done] = least[done], spot[done]
        open_[done] = False
    return whole, name, place


def stretches(words: np.ndarray, doc: np.ndarray, size: int, rounds: int = ROUNDS):
    """The runs of windows that share one symbol: ``(symbol, content, start, count)`` as four arrays.

    ``content`` verifies: it is a hash of all words that the run's windows cover and of where the symbol stands among them.
    All windows of a run hold its symbol's place, so that a run has at most ``size`` of them.
    """
    none = np.empty(0, np.int64)
    if not len(words):
        return none.view(np.uint64), none.view(np.uint64), none, none
    spans = Spans(words)
    whole, name, place = anchors(words, doc, size, rounds)
    at = np.flatnonzero(whole)
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    new = (np.diff(at) != 1) | (np.diff(place[at]) != 0) | (np.diff(doc[at]) != 0) | (name[at][1:] != name[at][:-1])
    head = np.flatnonzero(np.append(True, new))
    start, count = at[head], np.diff(np.append(head, len(at)))
    content = mix(spans.hash(start, start + count + size - 1) + (place[start] - start).astype(np.uint64) * _PAIR)
    return name[start], content, start, count
