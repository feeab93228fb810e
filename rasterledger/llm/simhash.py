"""Near duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints that differ in few bits agree in most of some blocks of bits, so they
meet in a cell of equal blocks. In a cell the Hamming distances to many reference
fingerprints are tabled first. A pair whose distances to any one reference differ
by more than the radius is farther apart than the radius (triangle inequality) and
is discarded; survivors are verified. A cell hands on one link for each fingerprint
that it joins to others, not one for each pair.

``near_duplicates`` links 64-bit fingerprints within a few bits, exactly.
``similar_documents`` is for a similarity of the shingle sets, exactly: sets meet in a cell
for each of their rarest shingles, and the shingles themselves decide, in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterledger.llm.components import connected
from rasterledger.llm.joins import spread_join
from rasterledger.llm.texts import chunks, mixed
from rasterledger.session import pin

SEED = 42
REFERENCES = 32
#: A larger cell is linked through shared neighbours, or for shingle sets cut into slabs of
#: which every two meet; all ways find the same links.
CELL_LIMIT = 16_384
#: Fingerprints of a cell that are compared with all others at once.
SLAB = 512


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) with the 64-bit SimHash of each whole text, as a signed long.

    A-Z are lower-cased; shingles are ``words`` words joined by blanks, repeats included;
    a shorter text is one shingle; a null or empty text has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch, texts in chunks(batches, "_text"):
            out = np.zeros(len(texts), np.uint64)
            place = np.uint64(1) << np.arange(64, dtype=np.uint64)
            for i in range(len(texts)):
                parts = texts.one(i).lower().split()
                if not parts:
                    continue
                stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
                joined = b" ".join(parts)
                reach = min(words, len(parts))
                ends = stops[reach - 1 :].tolist()
                begins = [0, *(stops[: len(parts) - reach] + 1).tolist()]
                hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)), np.uint64, len(ends))
                counts = np.zeros(64, np.int64)
                for k in range(0, len(hashes), 1 << 16):
                    bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    counts += bits.sum(axis=0, dtype=np.int64)
                out[i] = place[2 * counts > len(hashes)].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out.view(np.int64))], names=[id_column, "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, fp long")


def references(count: int = REFERENCES, words: int = 1) -> np.ndarray:
    """Reference fingerprints (references, words): pseudo-random, always the same."""
    numbers = np.arange(1, count * words + 1, dtype=np.uint64).reshape(count, words)
    return mixed(numbers * np.uint64(0x9E3779B97F4A7C15))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints whose 64-bit words are on the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def distance_table(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference (fingerprints, references)."""
    return np.stack([distances(values, pivot) for pivot in pivots], axis=1)


def cell_links(values: np.ndarray, pivots: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a cell the position of the first one it is joined to, over any steps.

    The fingerprints are put in the order of the first reference's distances, so each slab
    meets only the stretch whose first coordinate is within the radius.
    """
    order = np.argsort(distances(values, pivots[0]), kind="stable")
    values = values[order]
    table = distance_table(values, pivots)
    first = table[:, 0]
    parent = np.arange(len(values))
    for start in range(0, len(values), SLAB):
        stop = min(start + SLAB, len(values))
        last = int(np.searchsorted(first, int(first[stop - 1]) + radius, side="right"))
        left, right = np.nonzero(np.abs(table[start:stop, None, 1] - table[None, start:last, 1]) <= radius)
        keep = right > left
        left, right = left[keep] + start, right[keep] + start
        for j in [0, *range(2, len(pivots))]:
            if not len(left):
                break
            near = np.abs(table[left, j] - table[right, j]) <= radius
            left, right = left[near], right[near]
        near = distances(values[left], values[right]) <= radius
        left, right = left[near], right[near]
        while len(left):
            low = np.minimum(parent[left], parent[right])
            before = parent.copy()
            for side in (parent[left], parent[right], left, right):
                np.minimum.at(parent, side, low)
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            if np.array_equal(parent, before):
                break
    out = np.empty(len(values), np.int64)
    out[order] = order[parent]
    return out


def _cells(blocks: int, radius: int):
    """Masks of the bits on which two fingerprints within the radius agree, for at least one mask."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, radius: int = 2, blocks: int = 5, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Links (a, b) between the nodes of fingerprints (fp, node) that join all pairs within the radius.

    Every pair of fingerprints within the radius is joined by these links, directly or
    over others within the radius.
    """
    if radius != 2 and cell_limit < 1 << 60:
        raise ValueError("cells over the limit are linked through shared neighbours, which is for a radius of 2")
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    cells = [F.struct(F.lit(i).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, mask in enumerate(_cells(blocks, radius))]
    placed = distinct.select("fp", "node", F.explode(F.array(*cells)).alias("cell")).select(
        F.col("cell.n").alias("n"), F.col("cell.key").alias("key"), "fp", "node"
    )
    placed = placed.repartition("n", "key").sortWithinPartitions("n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references()
        for rows, over in _whole_cells(batches, ("n", "key", "node", "fp"), cell_limit):
            a, b = (rows[:, 2], rows[:, 3]) if over else _linked(rows, pivots, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    found = pin(placed.mapInArrow(run, "a long, b long, over boolean"))
    # Rows of cells over the limit are (node, fingerprint). Fingerprints within two bits have a
    # neighbour in common, and at most 65 fingerprints have the same neighbour.
    over = found.where("over").select(F.col("a").alias("node"), F.col("b").alias("fp")).distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)]
    shared = over.select("node", F.explode(F.array(*flips)).alias("key")).groupBy("key").agg(F.collect_set("node").alias("nodes"))
    near = shared.where(F.size("nodes") > 1).select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b"))
    return found.where("not over").select("a", "b").unionByName(near.where("a <> b")).distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], limit: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows of whole cells, or marked True those of a cell over the limit, part by part; a cell has equal first two columns."""
    held: list[np.ndarray] = []
    cell, size, spilling = None, 0, False
    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        if not len(rows):
            continue
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        if cell is not None and (rows[0, :2] == cell).all():
            lead = int(starts[1]) if len(starts) > 1 else len(rows)
            if spilling:
                yield rows[:lead], True
            else:
                held.append(rows[:lead])
                size += lead
            rows, starts = rows[lead:], starts[1:] - lead
        if len(rows):
            last = int(starts[-1])
            if held or last:
                yield np.concatenate([*held, rows[:last]]), False
            held, cell, spilling = [rows[last:]], rows[-1, :2], False
            size = len(rows) - last
        if size > limit and not spilling:
            yield np.concatenate(held), True
            held, spilling = [], True
    if held:
        yield np.concatenate(held), False


def _linked(rows: np.ndarray, pivots: np.ndarray, radius: int, small: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links between the nodes of whole cells, rows (n, key, node, words of the fingerprint).

    Cells of at most ``small`` members, which most are, are done all together. A fingerprint is
    linked to the first and to the last of those before it that are near; in a larger cell to
    one. Links thus grow with the fingerprints and not with the pairs of a group.
    """
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    counts = np.diff(np.r_[starts, len(rows)])
    fp = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.repeat(np.cumsum(counts) - 1, counts) - np.arange(len(rows))  # members behind in the cell
    left[np.repeat(counts > small, counts)] = 0
    table = distance_table(fp, pivots) if (left > 0).any() else None
    first, last = np.full(len(rows), len(rows)), np.full(len(rows), -1)
    for lag in range(1, small):
        one = np.flatnonzero(left >= lag)
        if not len(one):
            break
        two = one + lag
        for j in range(len(pivots)):
            near = np.abs(table[one, j] - table[two, j]) <= radius
            one, two = one[near], two[near]
        near = distances(fp[one], fp[two]) <= radius
        last[two[near]] = np.maximum(last[two[near]], one[near])
        first[two[near]] = np.minimum(first[two[near]], one[near])
    linked = np.flatnonzero(last >= 0)
    for before in (first, last):
        a.append(rows[before[linked], 2])
        b.append(rows[linked, 2])
    for start, count in zip(starts[counts > small].tolist(), counts[counts > small].tolist(), strict=True):
        to = cell_links(fp[start : start + count], pivots, radius)
        moved = np.flatnonzero(to != np.arange(count))
        a.append(rows[start + moved, 2])
        b.append(rows[start + to[moved], 2])
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    radius: int = 2,
    blocks: int = 5,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """One row per document: (id, fp, component_id).

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest
    id reachable over links, the own one included. Null and empty texts have fingerprint
    zero and link like any other. Ids are to be integers without repeats; rows that repeat
    an id each keep their fingerprint. Other columns are left out; an empty table gives an
    empty one.
    """
    marked = pin(fingerprints(docs, id_column, text_column, words))
    total = marked.count()
    groups = pin(marked.groupBy("fp").agg(F.min(id_column).cast("long").alias("node"), F.count("*").alias("_size")))
    roots = connected(links(groups, radius, blocks, cell_limit))
    rooted = groups.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), "_size")
    return spread_join(marked, rooted, "fp", "_size", total).select(id_column, "fp", "component_id")


#: Counters of a sketch of how many documents have a shingle, and the parts in which it is added up.
SKETCH = 1 << 21
SKETCH_PARTS = 256
#: How much farther a member looks in its cell from round to round, and how many more pairs of
#: two components a round may verify. The last round looks at all and verifies all.
ROUND_GROWTH = 4
#: Pairs of a round that are joined by broadcast: 32 bytes each. Beyond, the texts are shuffled.
BROADCAST_PAIRS = 500_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text after lower-casing A-Z, sorted."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    reach = min(words, len(parts))
    found = {xxhash.xxh64_intdigest(b" ".join(parts[i : i + reach]), SEED) for i in range(len(parts) - reach + 1)}
    return np.array(sorted(found), np.uint64)


def set_digest(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a set of shingles."""
    import xxhash

    value = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _set_digests(rows: DataFrame, words: int) -> DataFrame:
    """(_id, digest) of the texts with a word, and (part, counts) of the sketch of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "digest", "part", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        counts = np.zeros(SKETCH, np.uint32)
        for batch, texts in chunks(batches, "_text"):
            ids, out = batch.column("_id").to_pylist(), ([], [])
            for i in range(len(texts)):
                hashes = shingle_hashes(texts.one(i), words)
                if len(hashes):
                    np.add.at(counts, hashes % np.uint64(SKETCH), np.uint32(1))
                    out[0].append(ids[i])
                    out[1].append(set_digest(hashes))
            gone = [None] * len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((*out, gone, gone), kinds, strict=True)], names=names)
        parts = counts.reshape(SKETCH_PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1)).tolist()
        gone = [None] * len(used)
        values = (gone, gone, used, [parts[i].tobytes() for i in used])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "_id long, digest long, part int, counts binary")


def _sketch(partial: DataFrame) -> np.ndarray:
    """Counters of all tasks added up."""

    def merged(rows: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SKETCH_PARTS, np.uint64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_py(), np.uint32)
        total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"part": rows.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, counts binary"
    found = partial.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(merged, kind).toArrow()
    counts = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.uint32)
    for part, held in zip(found["part"].to_pylist(), found["counts"].to_pylist(), strict=True):
        counts[part] = np.frombuffer(held, np.uint32)
    return counts.ravel()


def _prefixes(rows: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """(key, digest, size, place): the first shingles of each set, the rare ones first.

    All sets are put in one order of shingles. Two sets with the similarity have so many in
    common that one of these stands among the first ``n - ceil(similarity * n) + 1`` of both;
    that holds for every order, so the sketch decides on the work only. A shingle that the
    sketch counts once is in no other set and is left out.
    """
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "_text"):
            out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in (np.uint64, np.int64, np.int64, np.int64)]
            met = set()
            for i in range(len(texts)):
                hashes = shingle_hashes(texts.one(i), words)
                size = len(hashes)
                digest = set_digest(hashes)
                if not size or digest in met:
                    continue
                met.add(digest)
                many = sent.value[hashes % np.uint64(SKETCH)]
                reach = size - int(np.ceil(similarity * size - 1e-6)) + 1
                first = np.lexsort((hashes, many))[:reach]
                place = np.flatnonzero(many[first] > 1)
                for column, value in zip(out, (hashes[first[place]], np.full(len(place), digest), np.full(len(place), size), place), strict=True):
                    column.append(value)
            key, digest, size, place = (np.concatenate(c) for c in out)
            arrays = [pa.array(key.view(np.int64)), pa.array(digest), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "digest", "size", "place"])

    return rows.mapInArrow(run, "key long, digest long, size int, place int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows of the cells that have two members or more, each member once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it has been handed on
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "digest", "size", "place")])
            fresh = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else np.empty(0, bool)
            rows = rows[fresh]
            if last is not None:
                if len(rows) and (rows[0, :2] == last[0][0, :2]).all():
                    rows = rows[1:]
                rows = np.concatenate([last[0], rows])
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            chosen = np.r_[False, same] | np.r_[same, False]
            done = last is not None and last[1]
            last = rows[-1:], bool(chosen[-1]) or (done and len(rows) == 1)
            if done:
                chosen[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(rows[chosen, k]) for k in range(4)], names=["key", "digest", "size", "place"])

    placed = prefixes.repartition("key").sortWithinPartitions("key", "digest")
    return placed.mapInArrow(run, "key long, digest long, size long, place long")


def _slabs(shared: DataFrame, limit: int) -> DataFrame:
    """The rows with (pair, side): a cell over the limit as cells of their own for each two of its slabs.

    Members are dealt to slabs by their digest. A row goes to the cells of its slab with every
    slab; side is -1 where that is the slab itself, so all pairs of its members count there.
    """
    large = shared.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("slabs"))
    dealt = shared.join(large, "key", "left").withColumn("slabs", F.coalesce("slabs", F.lit(1)))
    dealt = dealt.withColumn("slab", F.pmod(F.xxhash64("digest"), F.col("slabs")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    low, high = F.least("slab", "other").cast("long"), F.greatest("slab", "other")
    side = F.when(F.col("slab") == F.col("other"), -1).when(F.col("slab") < F.col("other"), 0).otherwise(1)
    return spread.select(*shared.columns, (low * F.col("slabs") + high).alias("pair"), side.cast("long").alias("side"))


def _proposed(cells: DataFrame, reach: int, cap: int, similarity: float) -> DataFrame:
    """Pairs (a, b, low, high) of digests of different components that meet in a cell and may have the similarity.

    A member is compared with the ``reach`` members after it. Discarded are only pairs whose
    sizes, or whose places in the order of shingles, rule the similarity out, and put off to
    later rounds those beyond ``cap`` for the components low and high in one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _whole_cells(batches, ("key", "pair", "side", "digest", "size", "place", "root"), 1 << 62):
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            counts = np.diff(np.r_[starts, len(rows)])
            behind = np.repeat(np.cumsum(counts), counts) - np.arange(len(rows)) - 1
            side, digest, size, place, root = rows[:, 2:].T
            one = np.flatnonzero(behind > 0)
            found = [np.empty((0, 4), np.int64)]
            lag = 1
            while lag <= reach and len(one):
                two = one + lag
                # Of two slabs only the pairs across are for this cell.
                near = (root[one] != root[two]) & ((side[one] < 0) | (side[one] != side[two]))
                left, right = one[near], two[near]
                small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
                rest = np.minimum(size[left] - place[left], size[right] - place[right])
                near = (small >= similarity * large - 1e-6) & (rest * (1 + similarity) >= similarity * (small + large) - 1e-6)
                left, right = left[near], right[near]
                swap = root[left] > root[right]
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                found.append(np.stack([root[left], root[right], digest[left], digest[right]], axis=1))
                lag += 1
                one = one[behind[one] >= lag]
            pairs = np.unique(np.concatenate(found), axis=0)
            fresh = np.flatnonzero(np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]) if len(pairs) else np.empty(0, np.int64)
            place = np.arange(len(pairs)) - np.repeat(fresh, np.diff(np.r_[fresh, len(pairs)]))
            low, high, a, b = pairs[place < cap].T
            arrays = [np.minimum(a, b), np.maximum(a, b), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "low", "high"])

    placed = cells.repartition("key", "pair").sortWithinPartitions("key", "pair", "digest")
    return placed.mapInArrow(run, "a long, b long, low long, high long").distinct()


def _verified(rows: DataFrame, members: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of digests whose shingle sets have the similarity at least; every text is read whole."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "_text"):
            found = [shingle_hashes(texts.one(i), words) for i in range(len(texts))]
            # A row that repeats an id with another text is not meant.
            meant = pa.array([set_digest(h) == d for h, d in zip(found, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            sets = pa.array([h.astype("<u8").tobytes() for h in found], pa.binary())
            arrays = [c.filter(meant) for c in (batch.column("a"), batch.column("b"), batch.column("digest"), sets)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "digest", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pair = None
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                pair, held = (row["a"], row["b"]), np.frombuffer(row["shingles"], "<u8")
                if open_pair is not None and open_pair[:2] == (pair, row["digest"]):
                    continue
                if open_pair is not None and open_pair[0] == pair:
                    common = len(np.intersect1d(open_pair[2], held, assume_unique=True))
                    if common >= similarity * (len(held) + len(open_pair[2]) - common):
                        a.append(pair[0])
                        b.append(pair[1])
                open_pair = pair, row["digest"], held
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("digest")).join(members, "digest")
    if pairs.count() <= BROADCAST_PAIRS:
        ends = F.broadcast(ends)
    sets = rows.join(ends, "_id").select("a", "b", "digest", "_text").mapInArrow(hashed, "a long, b long, digest long, shingles binary")
    return sets.repartition("a", "b").sortWithinPartitions("a", "b", "digest").mapInArrow(compared, "a long, b long")


def _open_cells(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """The cells with their members' roots of now, without the cells whose members are all of one component."""
    known = roots.select(F.col("node").alias("digest"), F.col("root").alias("_now"))
    if known.count() <= BROADCAST_PAIRS:
        known = F.broadcast(known)
    rooted = cells.join(known, "digest", "left").withColumn("root", F.coalesce("_now", "digest")).drop("_now")
    cell = Window.partitionBy("key", "pair")
    bounded = rooted.withColumns({"_low": F.min("root").over(cell), "_high": F.max("root").over(cell)})
    return bounded.where("_low < _high").select(*cells.columns)


def _linked_sets(rows: DataFrame, members: DataFrame, shared: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the digests whose sets are linked to others.

    Rounds: pairs of a cell within a reach are verified, a few for any two components; those
    that hold are contracted to components, and then the pairs between different components
    are proposed with a longer reach. The last round has no limit, so every pair between
    components has been verified.
    """
    cells = _slabs(shared, CELL_LIMIT).withColumn("root", F.col("digest"))
    tried = roots = None
    reach, cap = 1, ROUND_GROWTH
    while True:
        biggest = cells.groupBy("key", "pair").count().agg(F.max("count")).first()[0] or 0
        if biggest < 2:
            break
        last = reach >= biggest
        pairs = _proposed(cells, 1 << 60 if last else reach, 1 << 60 if last else cap, similarity)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        if not last:
            order = Window.partitionBy("low", "high").orderBy("a", "b")
            pairs = pairs.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= cap)
        pairs = pin(pairs.select("a", "b"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        held = pin(_verified(rows, members, pairs, words, similarity))
        # What has been found so far is known by its roots.
        roots = connected(held if roots is None else held.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if last:
            break
        cells = pin(_open_cells(cells, roots))
        reach, cap = ROUND_GROWTH * reach, ROUND_GROWTH * cap
    return roots if roots is not None else shared.select(F.col("digest").alias("node"), F.col("digest").alias("root")).limit(0)


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows that are linked to others: (id, component_id).

    Documents link if the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``similarity``: all such pairs are found, and each is checked on the shingles or lies
    inside a component already. component_id is the smallest id reachable. Documents with no
    link, without a word, or without an id are not returned. Rows that repeat an id are
    compared each, and the id has one row with the smallest component of them. Other columns
    are left out; an empty table gives an empty one.
    """
    rows = docs.select(docs[id_column].cast("long").alias("_id"), docs[text_column].cast("string").alias("_text")).where("_id is not null")
    partial = pin(_set_digests(rows, words))
    codes = partial.where("part is null").select("_id", "digest").distinct()
    members = codes.groupBy("digest").agg(F.min("_id").alias("_id"))
    shared = pin(_shared(_prefixes(rows, _sketch(partial), words, similarity)))
    roots = _linked_sets(rows, members, shared, words, similarity)
    rooted = codes.join(roots, codes["digest"] == roots["node"], "left").select("_id", F.coalesce("root", "digest").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("_id").alias("component_id"), F.max("_id").alias("_last")).where("component_id < _last")
    met = rooted.join(whole, "root").groupBy("_id").agg(F.min("component_id").alias("component_id"))
    return met.select(F.col("_id").alias(id_column), "component_id")
