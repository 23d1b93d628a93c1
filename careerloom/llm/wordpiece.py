"""Token counts of greedy longest-match word pieces, in time linear in the word.

The vocabulary is a trie over bytes. Where a match cannot go on, a node's
failure link leads to the node that stands for what is left of the text read so
far after the longest pieces have been popped off its front; how many pieces
that pops is stored with the link. A word's count is then the sum of popped
counts along one walk over its bytes: no piece is ever built, and no byte is
read twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.llm.common import batches_of, rows_of, words_of

#: One past the bytes: the sign for the end of a word.
END = 256


class LongestMatch:
    """Automaton over pieces given as tuples of symbols 0..256.

    The end sign alone may be a piece; it counts nothing.
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.step: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                to = self.step[node].get(symbol)
                if to is None:
                    to = self.step[node][symbol] = len(self.step)
                    self.step.append({})
                    ends.append(False)
                node = to
            ends[node] = node != 0
        n = len(self.step)
        # fail[v] < 0: what v stands for cannot be split into pieces any further.
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:  # by depth, so that a node's links rest on shallower ones
            node = queue.popleft()
            for symbol, to in self.step[node].items():
                if ends[to]:
                    self.fail[to], self.popped[to] = 0, int((node, symbol) != (0, END))
                else:
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and symbol not in self.step[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[to], self.popped[to] = self.step[at][symbol], count
                queue.append(to)

    def count(self, word: bytes, end: bool = True) -> int:
        """Number of pieces of the word and its end sign; 0 if it has no such split."""
        node, count = 0, 0
        step, fail, popped = self.step, self.fail, self.popped
        for symbol in (*word, END) if end else word:
            to = step[node].get(symbol)
            while to is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                to = step[node].get(symbol)
            node = to
        while node:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return count


def byte_alphabet() -> dict[str, int]:
    """The printable sign of every byte in byte-level vocabularies: itself if printable, else from 256 upwards."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    signs = {chr(b): b for b in own}
    signs.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return signs


class _Counts(dict):
    def __init__(self, automaton: LongestMatch, most: int = 200_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(2)
def counter(path: str, word_end: str = "</w>") -> _Counts:
    """Counts by the pieces of a vocabulary file whose word-final pieces end in ``word_end``."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    signs = byte_alphabet()
    pieces = []
    for piece in vocabulary:
        final = piece.endswith(word_end) and piece != word_end
        body = piece[: -len(word_end)] if final else piece
        if all(c in signs for c in body):
            pieces.append(tuple(signs[c] for c in body) + ((END,) if final else ()))
    # A word may also end in a piece that is not a final one.
    return _Counts(LongestMatch([*pieces, (END,)]))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every row, over whole texts.

    Words are runs without white space, A-Z in lower case. A word that the
    vocabulary cannot cover counts as one unknown token. Null and empty texts
    have no words. Repeated rows come back as often as they came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column("text")):
                n = list(map(counts.__getitem__, words_of(text.as_py())))
                unknown = n.count(0)
                out[i] = len(n), sum(n) + unknown, unknown
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in out.T)], names=["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    rows = rows_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return batches_of(rows, run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
