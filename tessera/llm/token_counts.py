"""Token counts of greedy longest-match word pieces by a linear automaton that never builds a piece."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import NO_ID, null_id, require, with_id

#: Words whose counts a Python worker remembers; beyond it new words are counted anew.
REMEMBERED = 300_000
#: The character that begins a piece which starts a word (a fixed value of the vocabulary's format).
START = "▁"


def load_pieces(path: str) -> list[str]:
    """The textual pieces of a sentencepiece model; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in plain]


def fallback(character: str) -> int:
    """Tokens of a character at which no piece begins: its UTF-8 bytes, for which byte pieces stand; none for ``START``."""
    return 0 if character == START else len(character.encode("utf-8", "surrogatepass"))


class Automaton:
    """A trie of the vocabulary with failure links and the number of tokens that each link pops.

    Let s be the string of a node. ``pops`` tells how many tokens greedy longest match takes off the
    front of s once no piece can go on past its end, and ``link`` is the node of what is left of s: the
    root if s is a piece itself, else a shorter node. Each character then goes down one step or fails
    over, so a word is read in time linear in its length and no piece is ever built. Pieces that start
    a word begin with ``START`` and hang below it.
    """

    def __init__(self, vocabulary: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                below = self.step[node].get(c)
                if below is None:
                    below = self.step[node][c] = len(self.step)
                    self.step.append({})
                    final.append(False)
                node = below
            final[node] = True
        self.link, self.pops = [0] * len(final), [0] * len(final)
        level = [0]
        while level:  # breadth first, for a link leads to a shorter string
            deeper = []
            for parent in level:
                for c, node in self.step[parent].items():
                    deeper.append(node)
                    if final[node]:
                        self.pops[node] = 1
                    elif parent:
                        self.link[node], more = self._fail(self.link[parent], c)
                        self.pops[node] = self.pops[parent] + more
                    else:
                        self.pops[node] = fallback(c)
            level = deeper

    def _fail(self, node: int, c: str) -> tuple[int, int]:
        """Where the character leads from a node, over links if need be, and what they pop."""
        popped = 0
        while c not in self.step[node]:
            if not node:
                return 0, popped + fallback(c)
            popped += self.pops[node]
            node = self.link[node]
        return self.step[node][c], popped

    def count(self, word: str) -> int:
        step, link, pops = self.step, self.link, self.pops
        total = node = 0
        for c in word:
            below = step[node].get(c)
            while below is None:
                if not node:
                    total += fallback(c)
                    below = 0
                else:
                    total += pops[node]
                    node = link[node]
                    below = step[node].get(c)
            node = below
        while node:
            total += pops[node]
            node = link[node]
        return total


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Greedy longest-match piece counts: ``doc_id, n_words, n_tokens`` for every row.

    ``vocabulary`` is the path of a sentencepiece model, of which only the list of pieces is used.
    Words are the runs outside \\x20 and \\x09-\\x0D; each is read as ``START`` + word. A ``START`` that
    no piece takes up costs nothing. Null and empty texts have no words and no tokens; repeated rows and rows without an id
    are counted each; an empty table gives no rows; other columns are ignored. Work is linear in the text, which is read whole
    however long it is, and no row meets another.
    """
    require(docs, ["doc_id", "text"])
    with open(vocabulary, "rb"):
        pass

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, known = Automaton(load_pieces(vocabulary)).count, {}

        def of(word: bytes) -> int:
            n = count(START + word.decode("utf-8", "surrogatepass"))
            if len(known) < REMEMBERED:
                known[word] = n
            return n

        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["text"]:
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                n_words.append(len(words))
                try:
                    n_tokens.append(sum([known[w] for w in words]))
                except KeyError:
                    n_tokens.append(sum([known[w] if w in known else of(w) for w in words]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], NO_ID: batch[NO_ID], "n_words": n_words, "n_tokens": n_tokens})

    return null_id(with_id(docs, "text").mapInPandas(run, f"doc_id long, {NO_ID} boolean, n_words long, n_tokens long"))
