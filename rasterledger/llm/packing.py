"""Packing of token ids into sequences by sum-of-squares online packing.

A window is a sequence under way; its fill level is the number of its ids. The
level array holds how many open windows stand at each level. A document goes to
the level (or a new window) after which the sum of the squared counts over all
partly filled levels is least; a window that is full leaves the array.

Documents longer than a window are cut into full windows and a rest. Whatever
is still open at the end of a task is laid end to end and cut into full windows;
the last few ids go to windows whose lengths are powers of two, so nothing is
padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rasterledger.llm.texts import chunks
from rasterledger.llm.vocabulary import Encoder, from_json

#: Open windows of a task before they are laid end to end; bounds its memory.
OPEN_WINDOWS = 4096
#: Sequence ids are the task's number in the high bits and a running number below.
TASK_BITS = 36


class Piece:
    """Some consecutive ids of one document."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, size: int) -> tuple["Piece", "Piece"]:
        return (
            Piece(self.doc, self.start, self.ids[:size], self.total),
            Piece(self.doc, self.start + size, self.ids[size:], self.total),
        )


class SquarePacker:
    """Level array with the open windows of each level; ``closed`` gathers full windows."""

    def __init__(self, capacity: int = 2048, open_windows: int = OPEN_WINDOWS):
        if capacity < 1:
            raise ValueError("a window must hold at least one id")
        self.capacity, self.limit = capacity, open_windows
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0
        self.closed: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """Level, 0 for a new window, that leaves the least sum of squares; of equals the fullest."""
        before = self.counts[: self.capacity - size + 1]
        after = self.counts[size:].copy()
        after[-1] = 0  # a full window is no longer partly filled
        change = 2 * after + 1 - (2 * before - 1)
        change[-1] -= 1  # nothing is added where the window becomes full
        change[0] = 2 * after[0] + (size < self.capacity)
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return self.capacity - size - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        rest = Piece(doc, 0, ids, len(ids))
        while len(rest.ids) >= self.capacity:
            full, rest = rest.cut(self.capacity)
            self.closed.append([full])
        size = len(rest.ids)
        if not size:
            return
        level = self.level_for(size)
        window = []
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        # A window under way keeps its ids for a later cut, so it must not hold the whole batch.
        window.append(Piece(doc, rest.start, rest.ids.copy(), rest.total))
        if level + size == self.capacity:
            self.closed.append(window)
            return
        self.windows.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        self.open += 1
        if self.open > self.limit:
            self.lay_out(final=False)

    def lay_out(self, final: bool = True) -> None:
        """Cut the open windows, fullest first, into full ones and a rest."""
        pieces = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.windows.clear()
        self.counts[:] = 0
        self.open = 0
        total = sum(len(p.ids) for p in pieces)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        if final:
            sizes += [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        elif rest:
            sizes.append(rest)
        pieces.reverse()
        for size in sizes:
            window, room = [], size
            while room:
                piece = pieces.pop()
                if len(piece.ids) > room:
                    piece, left = piece.cut(room)
                    pieces.append(left)
                window.append(piece)
                room -= len(piece.ids)
            if final or size == self.capacity:
                self.closed.append(window)
            else:
                self.windows[size] = [window]
                self.counts[size] = 1
                self.open = 1


def packed(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    open_windows: int = OPEN_WINDOWS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with the sequence and the place each stands in.

    Every document is its ids by the vocabulary file and then ``end_id``. Returns
    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and with
    ``with_ids`` the ids. A null or empty text is the end id alone; repeated rows are
    packed each; other columns of ``docs`` are left out; an empty table gives an empty
    one. Each task packs the rows it reads, so nothing is shuffled, and a task that is
    run again gives the same pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(from_json(path))
        packer = SquarePacker(capacity, open_windows)
        first = TaskContext.get().partitionId() << TASK_BITS
        done = 0

        def rows() -> pa.RecordBatch:
            nonlocal done
            windows, packer.closed = packer.closed, []
            numbers = [first + done + i for i, w in enumerate(windows) for _ in w]
            done += len(windows)
            pieces = [p for w in windows for p in w]
            lengths = [len(p.ids) for p in pieces]
            offsets = []
            for window in windows:
                place = 0
                for piece in window:
                    offsets.append(place)
                    place += len(piece.ids)
            arrays = [
                pa.array([p.doc for p in pieces], id_type),
                pa.array([p.start for p in pieces], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(p.ids.tobytes()) for p in pieces], pa.int64()),
                pa.array([p.total for p in pieces], pa.int64()),
                pa.array(numbers, pa.int64()),
                pa.array(offsets, pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.array([p.ids.astype(np.int64) for p in pieces], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        id_type = pa.int64()
        for batch, texts in chunks(batches, "_text"):
            id_type = batch.schema.field("_id").type
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            start = 0
            for doc, end in zip(batch.column("_id").to_pylist(), ends.tolist(), strict=True):
                packer.add(doc, ids[start:end])
                start = end
            yield rows()
        packer.lay_out()
        yield rows()

    kind = docs.schema[id_column].dataType.simpleString()
    columns = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows_in = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    return rows_in.mapInArrow(run, columns + (", ids array<long>" if with_ids else ""))
