"""Token counts by a compiled finite-state tokenizer.

Two transducers work one after the other. The first splits whole texts into
pre-tokens; chunks of the texts are maps from state to state that a parallel
prefix scan composes (``pretokens``). The second reads a pre-token byte by byte;
each transition carries the number of tokens by which the encoding grows or
shrinks, so the number of tokens is the sum along the path. It is compiled from
the vocabulary on demand: a state and its transitions come into being when a
text first reaches them.

A state of the second transducer holds what the future can depend on. Every
proper prefix of a token that is a suffix of what has been read may become a
token; for each of them it keeps the place in the token trie, the last token of
the encoding of all that stands before it, and that encoding's number of tokens
relative to the present one. A token may follow another exactly if no merge
goes across their border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterledger.llm.pretokens import Splitter, words_of
from rasterledger.llm.texts import chunks
from rasterledger.llm.vocabulary import Parts, Vocabulary, from_json

#: Transitions kept before the compiled part is dropped and built anew; bounds memory only.
KEPT_TRANSITIONS = 1_500_000


class CountingTransducer:
    """Deterministic transducer from the bytes of a pre-token to its number of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        names = list(vocabulary.ids)
        number = {name: i for i, name in enumerate(names)}
        # Merges by rank: of two tokens, and the one that made each token; a byte has none.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made = [(-1, -1, -1)] * len(names)
        for (left, right), rank in vocabulary.merges.items():
            self.ranks[number[left], number[right]] = rank
            self.made[number[left + right]] = rank, number[left], number[right]
        # Trie over the tokens: (node, byte) -> node; node -> token index where one ends.
        self.children: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        size = 1
        for index, token in enumerate(names):
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.children:
                    self.children[key] = size
                    size += 1
                node = self.children[key]
            self.ends[node] = index
        self.inner = {key >> 8 for key in self.children}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.keys = [start]
        self.numbers = {start: 0}
        #: state << 8 | byte -> (next state, change of the number of tokens)
        self.table: dict[int, tuple[int, int]] = {}

    def follows(self, last: int, token: int) -> bool:
        """Whether no merge goes across the border of the two.

        The merges inside both are undone, the latest first. A merge across the border
        would have come first if its rank is lower than that of the one just undone, or
        equal to it and further to the left.
        """
        if last < 0:
            return True
        found = self.pairs.get((last, token))
        if found is not None:
            return found
        left, right, limit = last, token, 1 << 60
        while True:
            if self.ranks.get((left, right), 1 << 60) < limit:
                found = False
                break
            a, b = self.made[left][0], self.made[right][0]
            if a < 0 and b < 0:
                found = True
                break
            if a > b:
                limit, left = a, self.made[left][2]
            else:
                limit, right = b + 1, self.made[right][1]
        self.pairs[last, token] = found
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        moved = []
        chosen = None
        for node, last, count in self.keys[state]:  # longest first
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            token = self.ends.get(child)
            if chosen is None and token is not None and self.follows(last, token):
                chosen = token, count + 1
            if child in self.inner:
                moved.append((child, last, count))
        token, change = chosen
        key = (*((node, last, count - change) for node, last, count in moved), (0, token, 0))
        number = self.numbers.setdefault(key, len(self.keys))
        if number == len(self.keys):
            self.keys.append(key)
        self.table[state << 8 | byte] = number, change
        return number, change

    def count(self, word: bytes) -> int:
        state = total = 0
        table = self.table
        for byte in word:
            step = table.get(state << 8 | byte)
            state, change = step if step is not None else self.compile(state, byte)
            total += change
        return total


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """Number of tokens of every whole text.

    Returns (id, n_bytes, n_tokens, over_limit). A null or empty text has no token;
    repeated rows are counted each; other columns of ``docs``, whatever their names,
    are left out; an empty table gives an empty one. Special strings of the file
    inside a text count as one token each. No shuffle: a task reads its rows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = from_json(path)
        splitter, transducer = Splitter(), CountingTransducer(vocabulary)
        for batch, texts in chunks(batches, "_text"):
            parts = Parts(texts, vocabulary.special)
            words = words_of(parts.texts, splitter)
            if len(transducer.table) > KEPT_TRANSITIONS:
                transducer.reset()
            sizes = np.fromiter(map(transducer.count, words.distinct), np.int64, len(words.distinct))
            sums = np.r_[0, np.cumsum(sizes[words.which])]
            ends = np.cumsum(words.counts)
            tokens = parts.per_text(sums[ends] - sums[ends - words.counts] + (parts.after >= 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(texts.lengths()), pa.array(tokens), pa.array(tokens > limit)],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
