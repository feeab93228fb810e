"""Alignment of the tokens of two tokenizers over the same bytes.

Both id lists of a text are laid over its bytes. The cumulative ends of one side are hashed
to their indices; the ends of the other side, in order, are intersected with these keys,
which cuts both lists into groups. Inside a group the tokens of the two sides overlap like the steps of
a stair, which gives its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rasterledger.llm.texts import CHUNK_BYTES, Texts
from rasterledger.llm.vocabulary import Encoder, Vocabulary, from_json
from rasterledger.session import pin

#: Id pairs that are looked up where their documents are read: those found in more documents
#: than this share of all (document, id pair) rows. There can be no more of them than this.
FREQUENT_PAIRS = 1_000_000
#: A pair of ids as one number: the first id above, the second below.
SHIFT = 32


class Pieces:
    """Bytes of every id of a vocabulary, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.texts = Texts.of(pieces)
        self.lengths = self.texts.lengths()

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.texts.offsets[ids] - (ends - sizes), sizes)
        return self.texts.data[at].tobytes()


def piece_bytes(model) -> list[bytes]:
    """Bytes of the pieces of a sentencepiece model; U+2581 is a space, <0xHH> a byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Encodes texts by both tokenizers and aligns what comes out; one object should serve a task."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        vocabulary = from_json(first)
        # Special strings are plain text here.
        self.first = Encoder(Vocabulary(vocabulary.ids, vocabulary.merges, {}))
        by_id = {i: token for token, i in vocabulary.ids.items()}
        self.first_pieces = Pieces([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        self.second_pieces = Pieces(piece_bytes(self.second))
        # Ids as text with what follows them: an id of the same side, the other side, the next group.
        self.width = max(len(self.first_pieces.lengths), len(self.second_pieces.lengths))
        self.written_ids = [f"{i}{sign}".encode() for sign in ",|;" for i in range(self.width)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both id lists of each text; both empty if either does not give back the bytes."""
        whole = [b" " + text.encode() if text else b"" for text in texts]
        ids, counts = self.first.encode(Texts.of(whole))
        stops = np.cumsum(counts)
        nothing = np.empty(0, np.int64)
        others = self.second.encode(texts, num_threads=1)
        for data, stop, count, other in zip(whole, stops.tolist(), counts.tolist(), others, strict=True):
            a, b = ids[stop - count : stop].astype(np.int64), np.array(other, np.int64)
            same = data and self.first_pieces.joined(a) == data and self.second_pieces.joined(b) == data
            yield (a, b) if same else (nothing, nothing)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where groups end on either side, and the linked id pairs as numbers, one for each link."""
        ends_a, ends_b = np.cumsum(self.first_pieces.lengths[a]), np.cumsum(self.second_pieces.lengths[b])
        # Ends of A grow, so its dictionary would give back places: they are looked up in that of B in order.
        at_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1), strict=True))
        met = np.fromiter(map(at_b.get, ends_a.tolist(), repeat(0)), np.int64, len(a))
        cut_a = np.flatnonzero(met) + 1
        cut_b = met[cut_a - 1]
        return cut_a, cut_b, _links(a, b, ends_a, ends_b, cut_a, cut_b)

    def written(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """Groups as text: ids of a side joined by a comma, sides by a bar, groups by a semicolon."""
        first_a, first_b = cut_a - np.diff(cut_a, prepend=0), cut_b - np.diff(cut_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        # A token of A comes after the B tokens of earlier groups, one of B after the A tokens of its group, too.
        place_a, place_b = np.arange(len(a)) + np.repeat(first_b, cut_a - first_a), np.arange(len(b)) + np.repeat(cut_a, cut_b - first_b)
        out[place_a], out[place_b] = a, b
        out[place_a[cut_a - 1]] += self.width
        out[place_b[cut_b - 1]] += 2 * self.width
        return b"".join(map(self.written_ids.__getitem__, out.tolist()))[:-1]


def _links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
    """Pairs of ids whose bytes overlap, slice by slice.

    A slice of m and n tokens has no end in common but the last, so a walk along its ends
    makes m + n - 1 steps, each inside one token of either side. Step k of a slice ends at
    its k-th end; all slices walk side by side. Slices of one token each need one step.
    """
    wide_a, wide_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    single = (wide_a == 1) & (wide_b == 1)
    alone = a[cut_a[single] - 1] << SHIFT | b[cut_b[single] - 1]
    in_a, in_b = np.flatnonzero(np.repeat(~single, wide_a)), np.flatnonzero(np.repeat(~single, wide_b))
    ends = np.concatenate([ends_a[in_a] * 2, ends_b[in_b] * 2 + 1])
    order = np.argsort(ends, kind="stable")
    side = order >= len(in_a)
    # How many tokens of either side have ended before; an end on both sides is one step.
    before_b = np.cumsum(side) - side
    before_a = np.cumsum(~side) - ~side
    ends = ends[order] >> 1
    step = np.ones(len(ends), bool)
    step[1:] = ends[1:] != ends[:-1]
    return np.concatenate([alone, a[in_a[before_a[step]]] << SHIFT | b[in_b[before_b[step]]]])


def _aligned(docs: DataFrame, first: str, second: str, id_column: str, text_column: str, with_groups: bool) -> DataFrame:
    """One row per document with its counts, digest and linked pairs (number and how often) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)
        for batch in batches:
            for part in _parts(batch):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                rows: list[tuple] = []
                for a, b in aligner.encode(texts):
                    if not len(a):
                        rows.append((0, 0, 0, 0, "", b"", b"", ""))
                        continue
                    cut_a, cut_b, links = aligner.align(a, b)
                    pairs, times = np.unique(links, return_counts=True)
                    groups = aligner.written(a, b, cut_a, cut_b)
                    digest = hashlib.sha256(groups).hexdigest()
                    rows.append((len(a), len(b), len(cut_a), len(links), digest, pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes(), groups.decode() if with_groups else ""))
                columns = list(zip(*rows, strict=True))[: 8 if with_groups else 7]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *arrays], names=["_id", *NAMES[: len(arrays)]])

    kind = docs.schema[id_column].dataType.simpleString()
    columns = f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    return rows.mapInArrow(run, columns + (", groups string" if with_groups else ""))


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most CHUNK_BYTES of text, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        limit = ends[start] - sizes[start] + CHUNK_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _pairs(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Packed numbers of all rows end to end, and the row each belongs to."""
    columns = [np.frombuffer(b"".join(batch.column(n).to_pylist()), "<i8") for n in names]
    sizes = np.fromiter((len(x) // 8 for x in batch.column(names[0]).to_pylist()), np.int64, len(batch))
    return *columns, np.repeat(np.arange(len(batch)), sizes)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents): how many documents hold each linked pair of ids, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting, size = [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([known, *waiting])
            weights = np.concatenate([totals, np.ones(len(pairs) - len(known), np.int64)])
            distinct, which = np.unique(pairs, return_inverse=True)
            return distinct, np.bincount(which, weights=weights, minlength=len(distinct)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known), pa.array(totals)], names=["pair", "documents"])

        for batch in batches:
            pairs, _ = _pairs(batch, "pairs")
            waiting.append(pairs)
            size += len(pairs)
            if size > 1 << 22:
                known, totals = added()
                waiting, size = [], 0
                if len(known) > 1 << 22:  # bounds the memory only
                    yield out()
                    known, totals = np.empty(0, np.int64), np.empty(0, np.int64)
        known, totals = added()
        yield out()

    rows = aligned.select("pairs").mapInArrow(run, "pair long, documents long")
    return rows.groupBy("pair").agg(F.sum("documents").alias("documents"))


class Frequent:
    """Counts of the pairs that very many documents hold, sorted by pair; ``best`` marks an id's highest."""

    def __init__(self, pairs: np.ndarray, documents: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.documents, self.best = pairs[order], documents[order], best[order]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair, and whether it is there."""
        if not len(self.pairs):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return at, self.pairs[at] == pairs


def aligned_documents(
    docs: DataFrame,
    first: str,
    second: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    frequent_pairs: int = FREQUENT_PAIRS,
    with_groups: bool = False,
) -> DataFrame:
    """Alignment of the tokens of a byte-level BPE (A) and a sentencepiece model (B) for every whole text.

    A encodes a space and the text, B the text, which adds the space itself; special strings
    are plain text. Offsets where tokens of both end cut them into groups; a link is a pair of
    tokens whose bytes overlap. The count of an id pair is the number of documents that hold
    it linked. Returns one row per document: (id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256) and with ``with_groups`` the groups as text. ``n_best`` counts
    links whose pair has the highest count of its A id, ties included; ``count_sum`` adds up the
    counts over all links.

    Texts that are null, empty or not given back by both tokenizers have no tokens: zeros and
    empty strings. Every row is a document, rows that repeat an id and rows without one
    too. Other columns are left out; an empty table gives an empty one.
    """
    aligned = pin(_aligned(docs, first, second, id_column, text_column, with_groups).withColumn("_row", F.monotonically_increasing_id()))
    counts = pin(pair_counts(aligned))
    # One row for each id of A, so no more than its vocabulary has.
    best = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("documents").alias("most"))
    marked = counts.join(F.broadcast(best), F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
    total = counts.agg(F.sum("documents")).first()[0] or 0
    often = F.col("documents") > total // frequent_pairs
    hot = marked.where(often).toArrow()
    numbers = (hot.column(n).to_numpy() for n in ("pair", "documents", "best"))
    frequent = docs.sparkSession.sparkContext.broadcast(Frequent(*numbers))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            pairs, times, row = _pairs(batch, "pairs", "times")
            at, found = table.find(pairs)
            at, times, row = at[found], times[found], row[found]
            sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
            if len(at):
                np.add.at(sums[0], row, times * table.best[at])
                np.add.at(sums[1], row, times * table.documents[at])
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, sums)], names=[*kept.schema.names, "_best", "_sum"])

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            pairs, times, row = _pairs(batch, "pairs", "times")
            rest = ~table.find(pairs)[1]
            rows = batch.column("_row").to_numpy()[row[rest]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pairs[rest]), pa.array(times[rest])], names=["_row", "pair", "times"])

    kept = [f for f in aligned.schema if f.name not in ("pairs", "times")]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    here = aligned.mapInArrow(known, columns + ", _best long, _sum long")
    rare = aligned.select("_row", "pairs", "times").mapInArrow(unknown, "_row long, pair long, times long").join(marked.where(~often), "pair")
    rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_more_best"), F.sum(F.col("times") * F.col("documents")).alias("_more"))
    met = here.join(rare, "_row", "left")
    zero = F.lit(0).cast("long")
    names = ["n_a", "n_b", "n_groups", "n_links"]
    return met.select(
        F.col("_id").alias(id_column),
        *names,
        (F.col("_best") + F.coalesce("_more_best", zero)).alias("n_best"),
        (F.col("_sum") + F.coalesce("_more", zero)).alias("count_sum"),
        "groups_sha256",
        *(["groups"] if with_groups else []),
    )
