"""Repeated byte strings by difference-cover suffix sorting, one bucket at a time.

Every string of ``length`` bytes that starts at two places of the corpus is to be
found. Of all suffixes only those at the positions of a difference cover are sorted:
for any two positions there is a shift below the period that takes both into the
cover, so two equal strings have two cover suffixes in them, less than a period
after their starts, that tie for at least ``length - period + 1`` bytes.

1. Cover suffixes go to buckets by the fingerprint of these bytes and each bucket is
   sorted by itself. Suffixes without a tie are dropped; the others have a rank, that of
   their tie class. A class in which all positions lie at the same residue is needed for
   the first residue only, as other equal strings show at the first one, too.
2. Ties are resolved at full length: a tied suffix brings the bytes around it, which
   hold every string that could repeat. They go to buckets by rank, and in each class
   the strings at equal distance before the suffix are compared.
3. The runs of positions found are joined for each document and its bytes cut out.

A task holds one bucket or one block of documents. Blocks and buckets grow in number
with the corpus. Equal entries of one block are merged before a shuffle, so a
passage that very many documents share reaches a bucket once for each block, unless all
of the block have it at one residue that is not the first; classes
that stay large are split by the bytes next to the tie. Strings are compared by
64-bit fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterledger.llm.texts import Fingerprints, Texts, chunks, mixed, texts_of
from rasterledger.session import pin

# Perfect difference covers: every residue is the difference of two of these. Fixed values.
COVERS = {
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
#: Bytes of text of a block, and cover suffixes of a bucket, on the average.
BLOCK_BYTES = 16 << 20
BUCKET_SUFFIXES = 2_000_000
#: Merged parts of the corpus that have a class from which on it is split by the bytes next to the tie.
LARGE_CLASS = 200
#: Bytes of texts whose cover suffixes are merged before they are sent on, and worked on at once.
MERGED_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
#: Entries whose strings are compared at once.
SLAB = 16_384
#: Words of a bitmap of documents with ties, or of large classes; its size is fixed.
BITMAP_WORDS = 1 << 17
BITMAP_PARTS = 64

_NO_ID = -(1 << 63)


def _planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as byte planes, so that the shuffle's compression takes the empty ones away."""
    values = np.ascontiguousarray(values, kind)
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


class Cover:
    """Positions of a difference cover, numbered in order."""

    def __init__(self, length: int, period: int):
        if period not in COVERS or period >= length:
            raise ValueError("the period must have a known cover and be below the length")
        self.length, self.period = length, period
        self.residues = np.array(COVERS[period], np.int64)
        self.tie = length - period + 1

    def positions(self, numbers: np.ndarray) -> np.ndarray:
        return numbers // len(self.residues) * self.period + self.residues[numbers % len(self.residues)]

    def count(self, size: int) -> int:
        """Cover positions of a text that have a whole tie behind them."""
        if size < self.length:
            return 0
        last = size - self.tie
        return int(last // self.period * len(self.residues) + np.searchsorted(self.residues, last % self.period, side="right"))


#: Suffixes known as tied that a task collects before it hands them on; bounds its memory.
KNOWN_SUFFIXES = 4_000_000


class _CoverBlock:
    """Cover suffixes of some texts; ``rows`` gives them by bucket, equal ones once."""

    def __init__(self, cover: Cover, buckets: int, mark_bytes: int):
        self.cover, self.buckets, self.mark_bytes = cover, buckets, mark_bytes
        self.prints = Fingerprints()
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: np.ndarray, texts: Texts) -> None:
        self.bytes += len(texts.data)
        counts = np.array([self.cover.count(n) for n in texts.lengths().tolist()], np.int64)
        used = counts > 0
        if not used.any():
            return
        ids, counts, offsets = ids[used], counts[used], texts.offsets[:-1][used]
        starts = self.cover.positions(_ordinals(counts)) + np.repeat(offsets, counts)
        sums = self.prints.sums(texts.data)
        self.values.append(self.prints.windows(sums, starts, starts + self.cover.tie))
        self.ids.append(ids)
        self.counts.append(counts)

    def rows(self) -> Iterator[tuple]:
        """(bucket, ids, counts, ordinals, marks, met, state): suffixes for the buckets, and with bucket -1 those known as tied.

        Of equal suffixes that are needed already only the first goes to a bucket.
        """
        if not self.values:
            return
        ids, counts, values = map(np.concatenate, (self.ids, self.counts, self.values))
        self.clear()
        ordinals = _ordinals(counts)
        owner = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(values, kind="stable")
        starts, sizes = _groups(values[order])
        repeated = np.zeros(len(values), bool)
        repeated[order] = np.repeat(sizes > 1, sizes)
        first = np.zeros(len(values), bool)
        first[order[starts]] = True
        # Residues met by the class in this block: one of them, or 255 for several.
        residue = (ordinals % len(self.cover.residues)).astype(np.uint8)
        low, high = np.minimum.reduceat(residue[order], starts), np.maximum.reduceat(residue[order], starts)
        met = np.zeros(len(values), np.uint8)
        met[order] = np.repeat(np.where(low == high, low, 255), sizes)
        # Copies within the block: those that count are known here already.
        needed = repeated & ((met == 255) | (met == 0))
        bucket = ((values >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        marks = values.view(np.uint8).reshape(-1, 8)[:, : self.mark_bytes]
        # Of a class at one other residue all members go to the bucket, which alone can tell whether
        # another block has the class at a second residue; then each of them counts.
        for sent, place in ((first | (repeated & ~needed), bucket), (needed & ~first, np.full(len(values), -1))):
            chosen = np.flatnonzero(sent)
            chosen = chosen[np.argsort(place[chosen], kind="stable")]
            at, many = _groups(place[chosen])
            for a, n in zip(at.tolist(), many.tolist(), strict=True):
                part = chosen[a : a + n]
                doc, per = _groups(owner[part])
                state = needed[part].astype(np.uint8)
                yield int(place[part[0]]), ids[owner[part[doc]]], per, ordinals[part], marks[part], met[part], state


def _ordinals(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _coded(per: np.ndarray, ordinals: np.ndarray) -> bytes:
    """Ordinals as steps within each document."""
    steps = np.diff(ordinals, prepend=0)
    starts = np.cumsum(per) - per
    steps[starts] = ordinals[starts]
    return _planes(steps)


def _decoded(per: np.ndarray, data: bytes) -> np.ndarray:
    steps = _from_planes(data).astype(np.int64)
    sums = np.cumsum(steps)
    starts = np.cumsum(per) - per
    return sums - np.repeat(sums[starts] - steps[starts], per)


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


_SUFFIXES = "bucket int, ids binary, counts binary, ordinals binary, marks binary, met binary, state binary"
_TIED = "block int, ids binary, counts binary, ordinals binary"


def tied_suffixes(docs: DataFrame, cover: Cover, buckets: int, blocks: int, mark_bytes: int) -> DataFrame:
    """Cover suffixes with a tie, by block: (block, ids, counts, ordinals); block -1 has the names of large classes."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _CoverBlock(cover, buckets, mark_bytes)

        def rows() -> Iterator[pa.RecordBatch]:
            found = list(block.rows())
            if not found:
                return
            columns = [
                pa.array([r[0] for r in found], pa.int32()),
                pa.array([_planes(r[1], "<i8") for r in found], pa.binary()),
                pa.array([_planes(r[2]) for r in found], pa.binary()),
                pa.array([_coded(r[2], r[3]) for r in found], pa.binary()),
                pa.array([r[4].tobytes() if r[0] >= 0 else b"" for r in found], pa.binary()),
                pa.array([r[5].tobytes() for r in found], pa.binary()),
                pa.array([r[6].tobytes() for r in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "ids", "counts", "ordinals", "marks", "met", "state"])

        for batch, texts in chunks(batches, "_text", CHUNK_BYTES):
            block.add(batch.column("_id").to_numpy(zero_copy_only=False), texts)
            if block.bytes >= MERGED_BYTES:
                yield from rows()
        yield from rows()

    def sorted_bucket(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Sort one bucket; give back the suffixes that tie with one of another block."""
        sizes = [len(r["met"]) for r in rows]
        marks = np.zeros((sum(sizes), 8), np.uint8)
        marks[:, :mark_bytes] = np.frombuffer(b"".join(r["marks"] for r in rows), np.uint8).reshape(-1, mark_bytes)
        values = marks.view(np.uint64).ravel()
        met = np.frombuffer(b"".join(r["met"] for r in rows), np.uint8)
        order = np.argsort(values, kind="stable")
        starts, counts = _groups(values[order])
        low, high = np.minimum.reduceat(met[order], starts), np.maximum.reduceat(met[order], starts)
        # A residue of its own in all blocks is enough only if it is the first one.
        needed = (counts > 1) & ((low != high) | (low == 255) | (low == 0))
        tied = np.zeros(len(values), bool)
        tied[order] = np.repeat(needed, counts)
        large = values[order[starts[needed & (counts > LARGE_CLASS)]]]
        if len(large):
            names = class_names(np.full(len(large), rows[0]["bucket"]), large).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([_planes(names, "<i8")]), pa.array([b""]), pa.array([b""])], names=["block", "ids", "counts", "ordinals"]
            )
        at, known = 0, []
        for row, size in zip(rows, sizes, strict=True):
            chosen = tied[at : at + size] | np.frombuffer(row["state"], np.uint8).astype(bool)
            if chosen.any():
                known.append(opened(row, chosen))
            at += size
        yield from by_block(known)

    def opened(row: dict, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ordinals of the chosen suffixes of a row, or of all."""
        ids, per = _from_planes(row["ids"], "<i8"), _from_planes(row["counts"]).astype(np.int64)
        ids, ordinals = np.repeat(ids, per), _decoded(per, row["ordinals"])
        return (ids, ordinals) if chosen is None else (ids[chosen], ordinals[chosen])

    def by_block(known: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """One row for each block that has some of these suffixes."""
        if not known:
            return
        ids, ordinals = (np.concatenate(x) for x in zip(*known, strict=True))
        block = _block_of(ids, blocks)
        order = np.lexsort((ordinals, ids, block))
        ids, ordinals, block = ids[order], ordinals[order], block[order]
        starts, counts = _groups(block)
        columns = [[], [], [], []]
        for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
            part = slice(a, a + n)
            doc, many = _groups(ids[part])
            for column, value in zip(columns, (int(block[a]), _planes(ids[part][doc], "<i8"), _planes(many), _coded(many, ordinals[part])), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "ids", "counts", "ordinals"])

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        known, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    known.append(opened(row))
                    size += len(row["met"])
                    if size > KNOWN_SUFFIXES:
                        yield from by_block(known)
                        known, size = [], 0
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from sorted_bucket(held)
                    held = []
                held.append(row)
        if held:
            yield from sorted_bucket(held)
        yield from by_block(known)

    # Rows that need no sorting are dealt out by their own content.
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    placed = docs.mapInArrow(sent, _SUFFIXES).repartition(buckets, spread).sortWithinPartitions("bucket")
    return placed.mapInArrow(sort_buckets, _TIED)


def class_names(buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Names of tie classes from what a bucket knows of them."""
    return mixed(marks + buckets.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bitmap(tied: DataFrame) -> np.ndarray:
    """Bits of the numbers in ``ids``, of a fixed number of words."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(BITMAP_WORDS, np.uint64)
        for batch in batches:
            for ids in batch.column("ids"):
                _mark(words, _from_planes(ids.as_py(), "<i8"))
        parts = words.reshape(BITMAP_PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["part", "words"])

    def merged(rows: pa.Table) -> pa.Table:
        words = np.zeros(BITMAP_WORDS // BITMAP_PARTS, np.uint64)
        for part in rows.column("words"):
            words |= np.frombuffer(part.as_py(), np.uint64)
        return pa.table({"part": rows.column("part").slice(0, 1), "words": pa.array([words.tobytes()], pa.binary())})

    kind = "part long, words binary"
    found = tied.select("ids").mapInArrow(bits, kind).groupBy("part").applyInArrow(merged, kind).toArrow()
    words = np.zeros((BITMAP_PARTS, BITMAP_WORDS // BITMAP_PARTS), np.uint64)
    for part, held in zip(found["part"].to_pylist(), found["words"].to_pylist(), strict=True):
        words[part] = np.frombuffer(held, np.uint64)
    return words.ravel()


def _mark(words: np.ndarray, ids: np.ndarray) -> None:
    place = mixed(ids.view(np.uint64))
    np.bitwise_or.at(words, (place >> np.uint64(6)) % np.uint64(BITMAP_WORDS), np.uint64(1) << (place & np.uint64(63)))


def _marked(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = mixed(ids.view(np.uint64))
    return (words[(place >> np.uint64(6)) % np.uint64(BITMAP_WORDS)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _with_block(docs: DataFrame, blocks: int, words: np.ndarray) -> DataFrame:
    """(block, _id, _text) of the documents that the bitmap may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            chosen = _marked(sent.value, ids)
            part = batch.filter(pa.array(chosen))
            block = pa.array(_block_of(ids[chosen], blocks).astype(np.int32))
            yield pa.RecordBatch.from_arrays([block, part.column("_id"), part.column("_text")], names=["block", "_id", "_text"])

    return docs.mapInArrow(run, "block int, _id long, _text string")


_ENTRIES = "block int, bucket int, ids binary, low binary, high binary, keys binary, reach binary, around binary"


class _Around:
    """The bytes around tied suffixes, and which strings of them are to be compared."""

    def __init__(self, cover: Cover, is_large=None):
        self.cover, self.is_large = cover, is_large
        self.before = cover.period - 1
        self.width = self.before + cover.length
        self.prints = Fingerprints()
        self.prints.sums(np.zeros(self.width, np.uint8))
        self.weights = self.prints.powers[: self.width]

    def entries(self, ids: np.ndarray, texts: Texts, ordinals: list[np.ndarray]):
        """Entries of a block: (ids, positions, keys, low, high, whole, places).

        [low, high] are the distances before the suffix at which a whole string of the text
        begins and is to be compared under this key. ``whole`` is equal if everything around
        is, and ``places`` is where the bytes around begin in ``self.padded``.
        """
        cover = self.cover
        out = []
        # Each text with so many empty bytes before and behind it that no entry leaves it.
        gap = self.before + cover.length
        shifts = texts.offsets[:-1] + gap * np.arange(len(texts)) + self.before
        self.padded = np.zeros(len(texts.data) + gap * len(texts), np.uint8)
        for i in range(len(texts)):
            numbers = np.unique(ordinals[i])
            size = int(texts.offsets[i + 1] - texts.offsets[i])
            at = cover.positions(numbers)
            at = at[at + cover.tie <= size]
            if not len(at) or size < cover.length:
                continue
            data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
            self.padded[shifts[i] : shifts[i] + size] = data
            sums = self.prints.sums(data)
            keys = self.prints.windows(sums, at, at + cover.tie)
            low = np.maximum(0, at + cover.length - size)
            high = np.minimum(self.before, at)
            whole = self.prints.windows(sums, at - high, np.minimum(at + cover.length, size))
            places = at + shifts[i] - self.before
            large = self.is_large(keys)
            parts = [(~large, keys, low, high)]
            if large.any():
                # Strings that begin well before a tie agree on the bytes before it, the others behind it.
                near = min(16, self.before // 2)
                back = large & (at >= near)
                left = np.maximum(at - near, 0)
                parts.append((back, mixed(keys + self.prints.windows(sums, left, np.maximum(at, left + 1))), np.maximum(low, near), high))
                stop = np.minimum(at + cover.length - near + 1, size)
                right = mixed(keys ^ self.prints.windows(sums, at, np.maximum(stop, at + 1)))
                parts.append((large & (at + cover.length - near + 1 <= size), right, low, np.minimum(high, near - 1)))
            for chosen, key, first, last in parts:
                chosen = chosen & (first <= last)
                if chosen.any():
                    out.append((np.full(int(chosen.sum()), ids[i]), at[chosen], key[chosen], first[chosen], last[chosen], mixed(whole[chosen] + key[chosen]), places[chosen]))
        if not out:
            return None
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def repeated(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slab by slab of entries in the order of their keys: which entries, and (entries, distances) found twice."""
        order = np.argsort(keys, kind="stable")
        starts, counts = _groups(keys[order])
        order = order[np.repeat(counts > 1, counts)]
        starts, counts = _groups(keys[order])
        begin = 0
        while begin < len(starts):
            stop = int(np.searchsorted(starts, starts[begin] + SLAB, side="right"))
            stop = max(begin + 1, min(stop, len(starts)) - (stop < len(starts)))
            last = int(starts[stop - 1] + counts[stop - 1])
            part = order[int(starts[begin]) : last]
            yield part, self._twice(keys[part], low[part], high[part], around[part])
            begin = stop

    def _twice(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, around: np.ndarray) -> np.ndarray:
        size = len(keys)
        terms = np.zeros((self.width + 1, size), np.uint64)
        np.cumsum((around.T.astype(np.uint64) + np.uint64(1)) * self.weights[:, None], axis=0, out=terms[1:])
        found = np.zeros((size, self.before + 1), bool)
        names = np.cumsum(np.r_[0, keys[1:] != keys[:-1]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for distance in range(self.before + 1):
            inside = np.flatnonzero((low <= distance) & (distance <= high))
            if len(inside) < 2:
                continue
            start = self.before - distance
            value = (terms[start + self.cover.length, inside] - terms[start, inside]) * self.prints.inverses[start]
            value = mixed(value) + names[inside]
            order = np.argsort(value)
            same = value[order[1:]] == value[order[:-1]]
            found[inside[order[1:][same]], distance] = True
            found[inside[order[:-1][same]], distance] = True
        return found


def _runs(ids: np.ndarray, positions: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Found distances as runs of start positions (id, first, last)."""
    padded = np.zeros((found.shape[0], found.shape[1] + 2), bool)
    padded[:, 1:-1] = found
    entry, first = np.nonzero(padded[:, 1:-1] & ~padded[:, :-2])
    _, last = np.nonzero(padded[:, 1:-1] & ~padded[:, 2:])
    return ids[entry], positions[entry] - last, positions[entry] - first


def repeat_starts(texts: DataFrame, tied: DataFrame, cover: Cover, buckets: int, blocks: int, mark_bytes: int) -> DataFrame:
    """Runs of positions at which repeated strings start: (block, ids, low, high)."""
    large = texts.sparkSession.sparkContext.broadcast(_bitmap(tied.where("block < 0")))
    mask = np.uint64((1 << 8 * mark_bytes) - 1)

    def is_large(keys: np.ndarray) -> np.ndarray:
        # A class that only seems large is split, too, and alike for all its members.
        return _marked(large.value, class_names((keys >> np.uint64(40)) % np.uint64(buckets), keys & mask).view(np.int64))

    def gathered(_, rows: pa.Table, suffixes: pa.Table) -> pa.Table:
        names = ["block", "bucket", "ids", "low", "high", "keys", "reach", "around"]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
        columns: list[list] = [[] for _ in names]

        def result() -> pa.Table:
            return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        if not rows.num_rows or not suffixes.num_rows:
            return result()
        block = rows.column("block")[0].as_py()
        numbers: dict[int, list[np.ndarray]] = {}
        for row in suffixes.to_pylist():
            ids, per = _from_planes(row["ids"], "<i8"), _from_planes(row["counts"]).astype(np.int64)
            ordinals = _decoded(per, row["ordinals"])
            for i, part in zip(ids.tolist(), np.split(ordinals, np.cumsum(per)[:-1]), strict=True):
                numbers.setdefault(i, []).append(part)
        wanted = rows.column("_id").to_numpy()
        has = np.array([i in numbers for i in wanted.tolist()], bool)
        rows = rows.filter(pa.array(has)).combine_chunks()
        ids = wanted[has]
        if not len(ids):
            return result()
        around = _Around(cover, is_large)
        batch = rows.to_batches()
        text = texts_of(pa.chunked_array([b.column("_text") for b in batch]).combine_chunks())
        entries = around.entries(ids, text, [np.concatenate(numbers[i]) for i in ids.tolist()])
        if entries is None:
            return result()
        ids, at, keys, low, high, whole, places = entries
        windows = np.lib.stride_tricks.sliding_window_view(around.padded, around.width)
        # Entries of this block that are the same all around: every string of theirs repeats.
        same = mixed(whole + low.astype(np.uint64) * np.uint64(1 << 20) + high.astype(np.uint64))
        order = np.argsort(same, kind="stable")
        starts, counts = _groups(same[order])
        several = np.repeat(counts > 1, counts)
        known = order[several]
        columns_of_known = (block, -1, _planes(ids[known], "<i8"), _planes(at[known] - high[known]), _planes(at[known] - low[known]), None, None, None)
        if len(known):
            for column, value in zip(columns, columns_of_known, strict=True):
                column.append(value)
        sent = order[starts]
        place = ((mixed(keys) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        sent = sent[np.argsort(place[sent], kind="stable")]
        starts, counts = _groups(place[sent])
        for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
            part = sent[a : a + n]
            values = (
                block,
                int(place[part[0]]),
                _planes(ids[part], "<i8"),
                _planes(at[part]),
                None,
                _planes(keys[part], "<u8"),
                np.stack([low[part], high[part]]).astype("<u2").tobytes(),
                pa.compress(windows[places[part]].tobytes(), codec="zstd", asbytes=True),
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return result()

    def compared(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Compare the strings of one bucket."""
        around = _Around(cover)
        sizes = np.array([len(r["keys"]) // 8 for r in rows])
        ids = np.concatenate([_from_planes(r["ids"], "<i8") for r in rows])
        at = np.concatenate([_from_planes(r["low"]) for r in rows]).astype(np.int64)
        keys = np.concatenate([_from_planes(r["keys"], "<u8") for r in rows])
        reach = np.concatenate([np.frombuffer(r["reach"], "<u2").reshape(2, -1) for r in rows], axis=1).astype(np.int64)
        near = np.concatenate(
            [np.frombuffer(pa.decompress(r["around"], decompressed_size=int(n) * around.width, codec="zstd", asbytes=True), np.uint8) for r, n in zip(rows, sizes, strict=True)]
        ).reshape(-1, around.width)
        block = np.repeat([r["block"] for r in rows], sizes)
        for part, found in around.repeated(keys, reach[0], reach[1], near):
            owner, low, high = _runs(part, at[part], found)
            yield from results(block[owner], ids[owner], low, high)

    def results(block, ids, low, high) -> Iterator[pa.RecordBatch]:
        order = np.argsort(block, kind="stable")
        starts, counts = _groups(block[order])
        columns: list[list] = [[], [], [], []]
        for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
            part = order[a : a + n]
            for column, value in zip(columns, (int(block[part[0]]), _planes(ids[part], "<i8"), _planes(low[part]), _planes(high[part])), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "ids", "low", "high"])

    def compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    values = [pa.array([row[c]], k) for c, k in (("block", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("high", pa.binary()))]
                    yield pa.RecordBatch.from_arrays(values, names=["block", "ids", "low", "high"])
                    continue
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from compared(held)
                    held = []
                held.append(row)
        if held:
            yield from compared(held)

    entries = texts.groupBy("block").cogroup(tied.where("block >= 0").groupBy("block")).applyInArrow(gathered, _ENTRIES)
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    placed = entries.repartition(buckets, spread).sortWithinPartitions("bucket")
    return placed.mapInArrow(compare_buckets, "block int, ids binary, low binary, high binary")


def joined_spans(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans [start, stop) of bytes covered by strings that start in the runs."""
    order = np.argsort(low, kind="stable")
    low, stop = low[order], np.maximum.accumulate(high[order] + length)
    fresh = np.r_[True, low[1:] > stop[:-1]]
    starts = low[fresh]
    return starts, stop[np.r_[np.flatnonzero(fresh)[1:] - 1, len(low) - 1]]


def cut_documents(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(_id, n_removed, n_spans, kept, left, starts, stops) of the documents that lose bytes; ``kept`` is what is left."""
    names = ["_id", "n_removed", "n_spans", "kept", "left", "starts", "stops"]
    longs = pa.list_(pa.int64())

    def cut(_, rows: pa.Table, found: pa.Table) -> pa.Table:
        ids = np.concatenate([np.empty(0, "<i8"), *(_from_planes(v.as_py(), "<i8") for v in found.column("ids"))])
        low, high = (
            np.concatenate([np.empty(0, np.int64), *(_from_planes(v.as_py()).astype(np.int64) for v in found.column(c))]) for c in ("low", "high")
        )
        order = np.argsort(ids, kind="stable")
        starts, counts = _groups(ids[order])
        where = {int(ids[order[a]]): order[a : a + n] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)}
        out: list[list] = [[] for _ in names]
        for doc, text in zip(rows.column("_id").to_pylist(), rows.column("_text"), strict=True):
            part = where.get(doc)
            if part is None:
                continue
            data = (text.as_py() or "").encode()
            first, stop = joined_spans(low[part], high[part], length)
            first, stop = np.minimum(first, len(data)), np.minimum(stop, len(data))
            held = stop > first
            first, stop = first[held].tolist(), stop[held].tolist()
            kept = b"".join(data[a:b] for a, b in zip([0, *stop], [*first, len(data)], strict=True))
            for column, value in zip(out, (doc, len(data) - len(kept), len(first), kept, kept.decode(errors="ignore"), first, stop), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), longs, longs)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return texts.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(
        cut, "_id long, n_removed long, n_spans long, kept binary, left string, starts array<long>, stops array<long>"
    )


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200, period: int = 91) -> DataFrame:
    """Documents that lose bytes: (id, n_removed, n_spans, kept, left, starts, stops).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in
    the same or another document; matches do not cross documents and are judged on the input.
    ``kept`` is the rest as bytes, ``left`` the same as text without characters of which a byte
    was cut, ``starts`` and ``stops`` the maximal removed runs.
    Documents that are shorter, empty or null lose nothing. Repeated rows are documents of
    their own, so each loses its bytes if it is long enough; rows with one id and different
    texts share the positions that are cut, as far as they reach. Other columns are left out;
    an empty table gives an empty one. Ids are integers; a null id is one more id.
    """
    spark = docs.sparkSession
    cover = Cover(length, period)
    rows = docs.select(F.coalesce(docs[id_column].cast("long"), F.lit(_NO_ID)).alias("_id"), docs[text_column].cast("string").alias("_text"))
    long_enough = rows.where(F.octet_length("_text") >= length)
    total = long_enough.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    suffixes = total * len(COVERS[period]) // period
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, 1 + suffixes // BUCKET_SUFFIXES)
    blocks = max(least, 1 + total // BLOCK_BYTES)
    # So many bytes that, by chance, at most one suffix in a million seems to tie.
    mark_bytes = max(4, min(8, -(-int(np.log2(max(suffixes, 2)) + 19 - np.log2(buckets)) // 8)))
    tied = pin(tied_suffixes(long_enough, cover, buckets, blocks, mark_bytes))
    texts = _with_block(long_enough, blocks, _bitmap(tied.where("block >= 0")))
    runs = pin(repeat_starts(texts, tied, cover, buckets, blocks, mark_bytes))
    texts = _with_block(long_enough, blocks, _bitmap(runs))
    found = cut_documents(texts, runs, length)
    return found.withColumn("_id", F.nullif("_id", F.lit(_NO_ID))).withColumnRenamed("_id", id_column)


def repeat_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200, period: int = 91) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    cut = cut_repeats(docs, id_column, text_column, length, period)
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    whole = docs.select(docs[id_column].alias("_doc"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_sha"))
    # Rows that repeat an id meet the cut of the row of their own length.
    short = cut.select(
        F.col(id_column).alias("_cut"), "n_removed", "n_spans", F.sha2("kept", 256).alias("_kept"), (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("_size")
    ).distinct()
    met = whole.join(short, F.col("_doc").eqNullSafe(F.col("_cut")) & (F.col("n_bytes") == F.col("_size")), "left")
    zero = F.lit(0).cast("long")
    return met.select(
        F.col("_doc").alias(id_column),
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("_kept", "_sha").alias("kept_sha256"),
    )
