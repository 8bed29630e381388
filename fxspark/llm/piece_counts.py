"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are counted in one pass over its characters. The vocabulary is a trie of initial
pieces and one of continuing pieces; where no child fits, a failure link leads to the node of what is left after the pieces
that greedy matching would have cut off, and a precomputed count says how many those are. No piece is ever built.

A word that has no full segmentation counts as one unknown piece. Null and empty texts have no words. Rows are counted
each on its own; other columns stay behind.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from fxspark.llm.common import bounded, raw

UNKNOWN = -1


class Automaton:
    """``initial`` pieces begin a word, ``continuing`` ones go on with it."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]  # nodes 0 and 1: the roots of the two tries
        piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for p in pieces:
                node = root
                for c in p:
                    node = self.child[node].setdefault(c, len(self.child))
                    if node == len(self.child):
                        self.child.append({})
                        piece.append(False)
                if node > 1:
                    piece[node] = True
        n = len(self.child)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0, 1]
        while level:
            following = []
            for node in level:
                for c, v in self.child[node].items():
                    following.append(v)
                    if piece[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, count = self.fail[node], self.popped[node]
                    while z >= 0 and c not in self.child[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][c], count
            level = following

    def count(self, word: str) -> int:
        """Pieces of a word, or UNKNOWN."""
        child, fail, popped = self.child, self.fail, self.popped
        node, total = 0, 0
        for c in word:
            while (to := child[node].get(c)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return UNKNOWN
            node = to
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node == 1 or not word else UNKNOWN


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Initial and continuing pieces of a sentencepiece model: those with and without the mark of a word's begin."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    mark = "▁"
    return [p[1:] for p in usable if p[0] == mark and len(p) > 1], [p for p in usable if mark not in p]


class Counts(dict):
    """Counts of words, remembered for up to ``most`` at a time."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        self.automaton, self.most = Automaton(*vocabulary(path)), most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        n = self[word] = self.automaton.count(word.decode())
        return n


@lru_cache(1)
def counts_of(path: str) -> Counts:
    return Counts(path)


def counted(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, words, pieces (an unknown word is one) and unknown words of every whole text."""

    def run(parts):
        counts = counts_of(model)
        for part in parts:
            words, pieces, unknown = [], [], []
            for text in raw(part.column(1)):
                found = list(map(counts.__getitem__, (text or b"").split()))
                odd = found.count(UNKNOWN)
                words.append(len(found))
                pieces.append(sum(found) + 2 * odd)
                unknown.append(odd)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (words, pieces, unknown))], ["doc_id", "n_words", "n_pieces", "n_unknown"])
        counts.clear()  # the worker may go on to other work

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")
