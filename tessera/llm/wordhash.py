"""Words and their hashes for a column of texts, by whole-array operations instead of a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; the temporaries of a piece are about forty times as large.
PIECE = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def portions(texts: list[bytes], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes; a longer text is a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that sums of products become hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hash_piece(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of one piece, which ends at a word's end."""
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = (np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)
    values = _BYTE[data[at]] * (mix(place + np.uint64(0x51ED270B)) | np.uint64(1))
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64)), starts, ends


def hash_words(texts: list[bytes], space: np.ndarray = _SPACE, ends: bool = False):
    """The 64-bit hashes of the words of all texts, end to end, and where each text's words begin.

    A word is a longest run of bytes outside ``space``. Returns ``(hashes, offsets)``, with
    ``offsets[i]:offsets[i + 1]`` the words of text i; with ``ends``, also each word's first byte
    and end within its own text. Equal words have equal hashes in any batch.
    """
    found, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        lengths = np.fromiter((len(texts[i]) + 1 for i in group), np.int64, len(group))
        data = np.frombuffer(b" ".join(texts[i] for i in group) + b" ", dtype=np.uint8)
        if not space[0x20]:
            raise ValueError("a blank must separate words")
        begin = np.cumsum(lengths) - lengths
        h, s, e = _hash_piece(data, space)
        owner = np.searchsorted(begin, s, side="right") - 1
        counts[np.asarray(group) + 1] += np.bincount(owner, minlength=len(group))
        found.append((h, s - begin[owner], e - begin[owner]))
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > PIECE:
            flush()
            for h, s, e in _long(text, space):
                counts[i + 1] += len(h)
                found.append((h, s, e))
            continue
        group.append(i)
        size += len(text) + 1
        if size > PIECE:
            flush()
    flush()
    offsets = np.cumsum(counts)
    whole = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.uint64 if not k else np.int64) for k in range(3)]
    return (whole[0], offsets, whole[1], whole[2]) if ends else (whole[0], offsets)


def _long(text: bytes, space: np.ndarray):
    """The words of one long text in pieces that are cut at white space."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + PIECE)
        while end < len(text) and not space[text[end]]:
            end += 1
        data = np.frombuffer(text, dtype=np.uint8, count=end - begin, offset=begin)
        h, s, e = _hash_piece(data, space)
        yield h, s + begin, e + begin
        begin = end


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; the last ``size - 1`` places wrap and must be ignored.

    Runs double in length and are joined as the binary digits of ``size`` ask, so that the work
    grows with the logarithm of the size.
    """
    left, right = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
    power, span, done, out = words, 1, 0, None
    while True:
        if size & span:
            out = power if out is None else mix(out * left + np.roll(power, -done) * right)
            done += span
        if done == size:
            return out
        power = mix(power * left + np.roll(power, -span) * right)
        span *= 2
