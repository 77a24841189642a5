"""Token counts by linear longest-match over a vocabulary trie."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.llm.texts import map_texts

#: Words whose count a task remembers.
REMEMBERED = 500_000


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file: a line for each, base64 bytes and rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class PieceCounter:
    """Number of pieces of greedy longest-match, in time linear in the text.

    Node v of the trie spells a string; `jump[v]` is the node to go on from when no edge of v
    fits, after the pieces that longest-match has by then cut off v's string, `popped[v]`
    of them. Both are computed once, breadth first. Counting follows edges and jumps and adds
    up `popped`; pieces are never built. Every single byte is a piece, so nothing is left over.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        self.edge: dict[int, int] = {}
        self.jump, self.popped = [0], [0]
        ends = {0}
        level: list[tuple[int, int, int]] = []  # (depth, parent, byte) of each node but the root
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            v = 0
            for d, b in enumerate(piece):
                key = v << 8 | b
                if key not in self.edge:
                    level.append((d, v, b))
                    self.edge[key] = len(level)
                v = self.edge[key]
            ends.add(v)
        self.jump += [0] * len(level)
        self.popped += [0] * len(level)
        for v in sorted(range(1, len(level) + 1), key=lambda v: level[v - 1][0]):
            if v in ends:
                self.popped[v] = 1
                continue
            _, up, b = level[v - 1]
            z, n = self.jump[up], self.popped[up]
            while (z << 8 | b) not in self.edge:
                z, n = self.jump[z], n + self.popped[z]
            self.jump[v], self.popped[v] = self.edge[z << 8 | b], n

    def count(self, word: bytes) -> int:
        edge, jump, popped = self.edge, self.jump, self.popped
        v = total = 0
        for b in word:
            while (to := edge.get(v << 8 | b)) is None:
                total += popped[v]
                v = jump[v]
            v = to
        while v:
            total += popped[v]
            v = jump[v]
        return total


class WordCounts(dict):
    def __init__(self, counter: PieceCounter) -> None:
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(b" " + word)
        if len(self) < REMEMBERED:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with `n_words` and `n_tokens` of the whole text.

    Words are runs without ASCII white space; each, with a blank before it, is cut greedily
    into the longest pieces of the vocabulary file at `vocabulary` (read on the driver and sent
    to the tasks; its size is the vocabulary's, whatever the data). Null and empty texts have 0
    words and tokens. Input columns of the two names are replaced, others pass through;
    repeated rows are counted alike, and an empty table gives an empty result.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        known = WordCounts(PieceCounter(pieces.value))

        def run(texts: list) -> list[list]:
            words, tokens = [], []
            for t in texts:
                cut = (t or "").encode("utf-8", "surrogatepass").split()
                words.append(len(cut))
                tokens.append(sum(map(known.__getitem__, cut)))
            return [words, tokens]

        return run

    keep = docs.drop("n_words", "n_tokens").withColumn("__text", F.col(text))
    return map_texts(keep, "__text", "n_words long, n_tokens long", make)
