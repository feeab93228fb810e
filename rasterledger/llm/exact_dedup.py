"""Exact duplicates by a cuckoo-filter index over text digests.

The index is a table of buckets. A bucket holds the digests of its live texts and
a cuckoo filter over them. A digest that the filter does not know is new; for one
that it may know, the bucket's digests decide. A live digest can be deleted again.
When the filter cannot place a fingerprint it is built anew, twice as large, from
the stored digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterledger.llm.joins import spread_join
from rasterledger.llm.texts import chunks
from rasterledger.session import pin

SLOTS = 4
KICKS = 64
#: Rows of the index that one bucket holds on the average.
BUCKET_ROWS = 50_000


class CuckooFilter:
    """Fingerprints of digests in buckets of four slots; each has two possible buckets."""

    def __init__(self, capacity: int = 64):
        self.size = 1 << max(1, (capacity // SLOTS).bit_length())
        self.slots: list[list[int]] = [[] for _ in range(self.size)]
        self.count = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "big") + 1
        first = int.from_bytes(digest[:8], "big") & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def may_hold(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return mark in self.slots[first] or mark in self.slots[second]

    def insert(self, digest: bytes) -> bool:
        """False, and nothing changed, if there is no room."""
        mark, first, second = self._places(digest)
        for place in (first, second):
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                self.count += 1
                return True
        place, moves = second, []
        for turn in range(KICKS):
            which = turn % SLOTS
            moves.append((place, which))
            self.slots[place][which], mark = mark, self.slots[place][which]
            place = self._other(place, mark)
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                self.count += 1
                return True
        for place, which in reversed(moves):
            self.slots[place][which], mark = mark, self.slots[place][which]
        return False

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for place in (first, second):
            if mark in self.slots[place]:
                self.slots[place].remove(mark)
                self.count -= 1
                return True
        return False


class DigestBucket:
    """Live digests of one bucket, each with the kept id and the number of its texts."""

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.content: dict[bytes, tuple[int, int]] = {}
        self.resizes = 0

    def _enter(self, digest: bytes) -> None:
        if self.filter.insert(digest):
            return
        room = SLOTS * self.filter.size
        while True:
            # Built anew from the stored digests, the new one among them.
            room *= 2
            self.filter = CuckooFilter(room)
            self.resizes += 1
            if all(map(self.filter.insert, self.content)):
                return

    def insert(self, digest: bytes, keep, size: int = 1) -> bool:
        """Add a text; True if its digest was not live before."""
        if self.filter.may_hold(digest):
            known = self.content.get(digest)  # the verdict is that of the stored digests
            if known is not None:
                ids = [i for i in (known[0], keep) if i is not None]
                self.content[digest] = max(ids, default=None), known[1] + size
                return False
        self.content[digest] = keep, size
        self._enter(digest)
        return True

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it is not there."""
        if not self.filter.may_hold(digest) or digest not in self.content:
            return False
        del self.content[digest]
        return self.filter.delete(digest)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, digest) with the SHA-256 of each whole text after lower-casing A-Z; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "_text"):
            found = [hashlib.sha256(texts.one(i).lower()).digest() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary())], names=[id_column, "digest"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, digest binary")


def index_of(marked: DataFrame, id_column: str, deleted: DataFrame | None = None) -> DataFrame:
    """Live digests (digest, keep_id, group_size) of rows (id, digest).

    Rows of one batch with one digest are added up before they are shuffled, so a digest
    reaches its bucket at most once for each batch. ``deleted`` has digests to take out
    after all insertions.
    """
    spark = marked.sparkSession
    kind = marked.schema[id_column].dataType.simpleString()

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.table({"digest": batch.column("digest"), "_id": batch.column("_id")}).group_by("digest")
            sums = groups.aggregate([("_id", "max"), ("digest", "count")])
            arrays = [sums["digest"], sums["_id_max"], sums["digest_count"], pa.array(np.zeros(len(sums), bool))]
            yield from pa.table(arrays, names=["digest", "keep_id", "group_size", "_delete"]).to_batches()

    rows = marked.select("digest", F.col(id_column).alias("_id")).mapInArrow(
        added_up, f"digest binary, keep_id {kind}, group_size long, _delete boolean"
    )
    if deleted is not None:
        gone = deleted.select("digest", F.lit(None).cast(kind).alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("_delete"))
        rows = rows.unionByName(gone.distinct())
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + marked.count() // BUCKET_ROWS)
    placed = rows.repartition(partitions, "digest").sortWithinPartitions("_delete")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keep_type = DigestBucket(), pa.int64()
        for batch in batches:
            keep_type = batch.schema.field("keep_id").type
            columns = (batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size", "_delete"))
            for digest, keep, size, gone in zip(*columns, strict=True):
                if gone:
                    bucket.delete(digest)
                else:
                    bucket.insert(digest, keep, size)
        live = list(bucket.content.items())
        columns = [pa.array([d for d, _ in live], pa.binary()), pa.array([k for _, (k, _) in live], keep_type), pa.array([n for _, (_, n) in live], pa.int64())]
        if live:
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "keep_id", "group_size"])

    return placed.mapInArrow(enter, f"digest binary, keep_id {kind}, group_size long")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are identical after lower-casing A-Z; of equal texts the row
    with the largest id stays. Null and empty texts are one group. Rows that repeat an id
    are all marked alike. A row without an id counts as smaller than all others: it is kept
    only where no row of its text has an id, and its keep_id is then null. Other columns are
    left out; an empty table gives an empty one.
    """
    marked = pin(digests(docs, id_column, text_column))
    total = marked.count()
    live = pin(index_of(marked, id_column))
    every = spread_join(marked, live.where("group_size > 1"), "digest", "group_size", total)
    return every.select(
        id_column,
        F.coalesce("keep_id", id_column).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("keep_id", id_column).eqNullSafe(F.col(id_column)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(x) as text_sha256
from t window g as (partition by x)"""
