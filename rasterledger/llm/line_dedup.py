"""Removal of lines that many documents share, by sharded minimal perfect hashes.

The distinct line hashes of the corpus are dealt to shards. Each shard builds a
minimal perfect hash over its hashes; its value indexes two compact arrays, one
with a fingerprint of the line and one with the number of documents that hold it.
Documents send the hashes of their lines to the shards, where they are looked up in
these arrays as they stream by; lines themselves are never joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterledger.llm.texts import mixed
from rasterledger.session import pin

#: Stripped at both ends of a line.
BLANKS = " \t\n\v\f\r"
#: Bytes of text for each shard; bounds the distinct lines that a shard can have.
SHARD_BYTES = 16 << 20
#: Shards that share a partition, so that partitions stay far fewer than shards.
SHARDS_TOGETHER = 8
#: A line in more documents than a millionth of all lines there can be is looked up
#: where its document is read. At most a million lines can be that frequent.
FREQUENT_SHARE = 1_000_000
#: No line is called frequent below this number of documents.
FREQUENT_LEAST = 1_000
#: Stands for a document without an id: smaller than every id.
NO_ID = -(1 << 63)


class PerfectHash:
    """Minimal perfect hash of distinct (high, low) hashes: levels of bits with ranks.

    A level has one bit for each key that is left; a key that is alone at its bit stays,
    the others go on to the next level. The place of a key is the rank of its bit.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.size = len(high)
        before = 0
        while len(high):
            width = -(-len(high) // 64) * 64
            spot = self._spots(high, low, len(self.levels), width)
            alone = np.bincount(spot, minlength=width) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append(words)
            self.ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())
            left = ~alone[spot]
            high, low = high[left], low[left]

    @staticmethod
    def _spots(high: np.ndarray, low: np.ndarray, level: int, width: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mixed(high ^ mixed(low + salt)) % np.uint64(width)).astype(np.int64)

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of each key, a number below ``size``; -1 for some keys that were not given."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            spot = self._spots(high[left], low[left], level, 64 * len(words))
            word, bit = words[spot >> 6], (spot & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (ranks[spot >> 6] + below)[here]
            left = left[~here]
        return out


class LineIndex:
    """Arrays of one shard: fingerprints and document counts by place, kept ids of the shared lines.

    Built from rows (high, low, id, documents). Of each line it is told at least its
    ``least`` largest ids, or all if there are fewer.
    """

    def __init__(self, high, low, ids, documents, least: int):
        order = np.lexsort((ids, low, high))
        high, low, ids, documents = high[order], low[order], ids[order], documents[order]
        change = np.ones(len(high), bool)
        change[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        fresh = change.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        begins = np.flatnonzero(change)
        distinct = np.add.reduceat(fresh.astype(np.int64), begins) if len(begins) else np.empty(0, np.int64)
        told = np.add.reduceat(documents, begins) if len(begins) else np.empty(0, np.int64)
        high, low = high[begins], low[begins]
        self.hash = PerfectHash(high, low)
        place = self.hash.places(high, low)
        self.prints = np.empty(len(high), np.uint32)
        self.prints[place] = low.astype(np.uint32)
        # Rows that repeat an id are counted, too, but a line is shared only by distinct ids.
        self.counts = np.empty(len(high), np.uint32)
        self.counts[place] = np.where(distinct >= least, np.minimum(told, 0xFFFFFFFF), 0)
        last = np.r_[begins[1:], len(ids)] - 1
        shared = self.counts > 0
        self.rank = np.cumsum(shared) - 1
        self.keep = np.empty(int(shared.sum()), np.int64)
        told_shared = distinct >= least
        self.keep[self.rank[place[told_shared]]] = ids[last[told_shared]]
        self.shared_keys = high[told_shared], low[told_shared], ids[last[told_shared]], told[told_shared]

    def dropped(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the lines with these hashes leave the documents with these ids."""
        place = self.hash.places(high, low)
        known = np.flatnonzero(place >= 0)
        at = place[known]
        known, at = (x[(self.prints[at] == low[known].astype(np.uint32)) & (self.counts[at] > 0)] for x in (known, at))
        out = np.zeros(len(high), bool)
        out[known] = self.keep[self.rank[at]] != ids[known]
        return out


def line_hash(line: str, least_chars: int) -> bytes | None:
    """128 bits of a line's key, or None if the key is too short to be looked at."""
    key = line.strip(BLANKS)
    if len(key) < least_chars:
        return None
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest()


def _hashes(text: str | None, least_chars: int) -> set[bytes]:
    found = {line_hash(line, least_chars) for line in (text or "").split("\n")}
    found.discard(None)
    return found


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _ids(column: pa.Array) -> list[int]:
    return [NO_ID if i is None else i for i in column.to_pylist()]


LINE_COLUMNS = "high long, low long, id long, documents long"


def _told(rows: DataFrame, least_chars: int, least_documents: int) -> DataFrame:
    """Lines of batches of documents: of each its largest ids, and how many rows hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holders: dict[bytes, list[int]] = {}
            for i, text in zip(_ids(batch.column("_id")), batch.column("_text").to_pylist(), strict=True):
                for value in _hashes(text, least_chars):
                    holders.setdefault(value, []).append(i)
            keys, ids, documents = [], [], []
            for value, all_ids in holders.items():
                largest = sorted(set(all_ids))[-least_documents:] if len(all_ids) > 1 else all_ids
                keys += [value] * len(largest)
                ids += largest
                documents += [len(all_ids)] + [0] * (len(largest) - 1)
            high, low = _halves(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(ids, pa.int64()), pa.array(documents, pa.int64())],
                names=["high", "low", "id", "documents"],
            )

    return rows.mapInArrow(run, LINE_COLUMNS)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of rows sorted by shard, cut where the shard changes."""
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(shards[a]), batch.slice(a, b - a)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _pack(index: LineIndex, frequent: int) -> list[bytes]:
    widths = np.array([len(words) for words in index.hash.levels], "<i8")
    high, low, keep, told = index.shared_keys
    hot = told > frequent
    return [
        widths.tobytes(),
        b"".join(words.tobytes() for words in index.hash.levels),
        index.prints.tobytes(),
        index.counts.tobytes(),
        index.keep.tobytes(),
        np.stack([high.view(np.int64), low.view(np.int64), keep], axis=1)[hot].tobytes(),
    ]


def _unpack(widths: bytes, levels: bytes, prints: bytes, counts: bytes, keep: bytes) -> LineIndex:
    hashing = PerfectHash(np.empty(0, np.uint64), np.empty(0, np.uint64))
    words, before, at = np.frombuffer(levels, "<u8"), 0, 0
    for width in np.frombuffer(widths, "<i8").tolist():
        level = words[at : at + width]
        ones = np.bitwise_count(level).astype(np.int64)
        hashing.levels.append(level)
        hashing.ranks.append(before + np.cumsum(ones) - ones)
        before, at = before + int(ones.sum()), at + width
    index = LineIndex.__new__(LineIndex)
    index.hash = hashing
    hashing.size = before
    index.prints, index.counts = np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32)
    index.keep = np.frombuffer(keep, np.int64)
    index.rank = np.cumsum(index.counts > 0) - 1
    return index


PARTS = ("widths", "levels", "prints", "counts", "keep", "hot")


def line_index(told: DataFrame, shards: int, partitions: int, least_documents: int, frequent: int) -> DataFrame:
    """One row of arrays for each shard: (shard, widths, levels, prints, counts, keep, hot)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            high, low, ids, documents = _numbers(pa.Table.from_batches(rows).combine_chunks().to_batches()[0], "high", "low", "id", "documents")
            index = LineIndex(high.view(np.uint64), low.view(np.uint64), ids, documents, least_documents)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([p], pa.binary()) for p in _pack(index, frequent))], names=["shard", *PARTS])

        current, rows = None, []
        for shard, batch in _by_shard(batches):
            if shard != current and rows:
                yield packed(current, rows)
                rows = []
            current = shard
            rows.append(batch)
        if rows:
            yield packed(current, rows)

    dealt = told.withColumn("shard", _shard(shards)).repartition(partitions, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(build, "shard long, " + ", ".join(f"{p} binary" for p in PARTS))


def _shard(shards: int):
    return F.pmod(F.xxhash64("high", "low"), F.lit(shards)).cast("long")


class Frequent:
    """The lines held by very many documents, sorted, each with the id that keeps it."""

    def __init__(self, packed: list[bytes]):
        rows = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 3)
        self.keep = {high.to_bytes(8, "little", signed=True) + low.to_bytes(8, "little", signed=True): keep for high, low, keep in rows.tolist()}


def _dropped(rows: DataFrame, index: DataFrame, shards: int, partitions: int, least_chars: int, frequent) -> DataFrame:
    """(id, lines): the hashes of all lines that leave the documents of an id, the frequent ones apart."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value.keep
        for batch in batches:
            keys, ids = [], []
            for i, text in zip(_ids(batch.column("_id")), batch.column("_text").to_pylist(), strict=True):
                found = [h for h in _hashes(text, least_chars) if h not in hot]
                keys += found
                ids += [i] * len(found)
            high, low = _halves(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(ids, pa.int64())], names=["high", "low", "id"]
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, arrays = None, None
        for shard, batch in _by_shard(batches):
            if shard != current:
                # The arrays of a shard come before what is looked up in them.
                first = batch.slice(0, 1)
                arrays = _unpack(*(first.column(p)[0].as_py() for p in PARTS[:-1]))
                current, batch = shard, batch.slice(1)
            high, low, ids = _numbers(batch, "high", "low", "id")
            gone = arrays.dropped(high.view(np.uint64), low.view(np.uint64), ids)
            pairs = np.stack([high[gone], low[gone]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[gone]), pa.array([p.tobytes() for p in pairs], pa.binary())], names=["id", "line"]
            )

    sent = rows.mapInArrow(send, "high long, low long, id long").withColumn("shard", _shard(shards))
    both = index.select("shard", *PARTS[:-1], F.lit(0).alias("kind")).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(partitions, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(probe, "id long, line binary").groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def line_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_chars: int = 20,
    least_documents: int = 3,
    shard_bytes: int = SHARD_BYTES,
    frequent_least: int = FREQUENT_LEAST,
    with_text: bool = False,
) -> DataFrame:
    """Documents without the lines that at least ``least_documents`` of them hold.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of
    at least ``least_chars`` code points held by at least ``least_documents`` documents
    lose all their lines, except in the document of the largest id. Returns one row per
    document: (id, n_lines, n_dropped, kept_sha256) and with ``with_text`` also kept_text.

    Documents are told apart by their id: rows that repeat an id are one holder, and each
    loses or keeps the same lines. Rows without an id count as one document before all
    others. A null or empty text has one empty line. Other columns are left out; an empty
    table gives an empty one. Texts of any length are taken whole. Keys are told apart by
    128 bits of BLAKE2b. Ids are integers.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].cast("long").alias("_id"), docs[text_column].alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, -(-size // (shard_bytes * SHARDS_TOGETHER)))
    shards = max(partitions * SHARDS_TOGETHER, -(-size // shard_bytes))
    often = max(frequent_least, size // (least_chars + 1) // FREQUENT_SHARE)
    index = pin(line_index(_told(rows, least_chars, least_documents), shards, partitions, least_documents, often))
    frequent = spark.sparkContext.broadcast(Frequent([r[0] for r in index.where(F.length("hot") > 0).select("hot").collect()]))
    gone = _dropped(rows, index, shards, partitions, least_chars, frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value.keep
        for batch in batches:
            counts, dropped, digests, texts = [], [], [], []
            values = zip(_ids(batch.column("_id")), batch.column("_text").to_pylist(), batch.column("lines").to_pylist(), strict=True)
            for i, text, known in values:
                lines = (text or "").split("\n")
                kept = lines
                if known or hot:
                    known = set(known or ())
                    kept = [x for x in lines if (h := line_hash(x, least_chars)) is None or not (h in known or hot.get(h, i) != i)]
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
                left = "\n".join(kept)
                digests.append(hashlib.sha256(left.encode()).hexdigest())
                texts.append(left if with_text else None)
            arrays = [batch.column("_given"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
            names = [id_column, "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    given = docs.select(docs[id_column].alias("_given"), docs[text_column].alias("_text"))
    given = given.withColumn("_id", F.coalesce(F.col("_given").cast("long"), F.lit(NO_ID)))
    met = given.join(gone, F.col("_id") == F.col("id"), "left").select("_given", "_id", "_text", "lines")
    columns = f"`{id_column}` {kind}, n_lines long, n_dropped long, kept_sha256 string"
    return met.mapInArrow(cut, columns + (", kept_text string" if with_text else ""))


SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
marked as (
  select doc_id, pos, line, keeper is not null and keeper <> doc_id as gone
  from keyed left join shared using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""
