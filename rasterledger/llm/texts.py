"""Texts of Arrow batches as NumPy byte arrays, and window fingerprints over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts worked on together inside a task; one longer text is worked on alone.
CHUNK_BYTES = 4 << 20
#: Odd multiplier of the polynomial fingerprints, modulo 2 ** 64. Fixed value.
BASE = np.uint64(0x9E3779B97F4A7C15)


def spare(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from the names taken."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


class Texts:
    """Some texts: their bytes one after the other and where each begins.

    ``offsets`` has one entry more than there are texts. A null counts as empty.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def one(self, index: int) -> bytes:
        return self.data[self.offsets[index] : self.offsets[index + 1]].tobytes()

    @staticmethod
    def of(values: list[bytes]) -> "Texts":
        data = np.frombuffer(b"".join(values), np.uint8)
        offsets = np.zeros(len(values) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=offsets[1:])
        return Texts(data, offsets)


def texts_of(column: pa.Array) -> Texts:
    values = column.cast(pa.large_string()).fill_null("")
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1] if ends else np.zeros(1, np.int64)
    if len(ends) == 0:
        ends = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(data[ends[0] : ends[-1]], ends - ends[0])


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with their texts, each of at most ``size`` bytes or one text."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        start = 0
        while start < len(texts):
            limit = texts.offsets[start] + size
            stop = max(start + 1, int(np.searchsorted(texts.offsets, limit, side="right")) - 1)
            first, last = texts.offsets[start], texts.offsets[stop]
            part = Texts(texts.data[first:last], texts.offsets[start : stop + 1] - first)
            yield batch.slice(start, stop - start), part
            start = stop


class Fingerprints:
    """Polynomial fingerprints of any window of a byte array, by prefix sums.

    The power tables are grown on demand and kept, so one object should serve a task.
    """

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if len(self.powers) < size:
            back = np.uint64(pow(int(BASE), -1, 1 << 64))
            size = max(size, 1 << 16)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, back)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums to pass to ``windows``."""
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.powers[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def windows(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Mixed 64-bit fingerprints of the windows [start, stop)."""
        value = (sums[stops] - sums[starts]) * self.inverses[starts]
        return mixed(value + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mixed(value: np.ndarray) -> np.ndarray:
    """Spread all bits over all others, so that any bits of the result can serve as a bucket."""
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    value = value ^ (value >> np.uint64(32))
    value = value * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))
