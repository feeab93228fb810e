"""Hard negatives by inner product over STR-packed R-trees.

Rows are dealt to groups by range, the label first. A group packs its rows into an
R-tree: sorted by one coordinate, cut into slabs, each slab sorted by the next
coordinate, and so on down to leaves. The boxes of leaves and of the nodes above
bound each coordinate, and so the inner product with any anchor: from below and from
above. An anchor takes leaves from a queue, the best upper bound first; boxes
whose interval lies outside its score window, or strictly below its k-th best score
so far, are pruned. Anchors of a batch move through their queues side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rasterledger.session import pin

#: Rows in a leaf, and leaves below a node.
LEAF, FAN = 128, 16
#: Rows of one group; a task holds one group at a time.
GROUP_ROWS = 65_536
#: Anchors that move through a tree side by side.
BATCH = 512
#: Leaves that an anchor takes from its queue in the first round; each round doubles it.
FIRST_LEAVES = 2
LEAST, MOST = -(1 << 62), 1 << 62
NONE = -(1 << 63)


class Tree:
    """R-tree of distinct (vector, label) rows, each with its smallest ids."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]]):
        order = self._packed(vectors, labels)
        self.vectors, self.labels = vectors[order], labels[order]
        self.ids = [ids[i] for i in order.tolist()]
        #: The id of a row that has one only, else NONE.
        self.sole = np.array([i[0] if len(i) == 1 else NONE for i in self.ids], np.int64)
        starts = np.arange(0, len(order), LEAF)
        self.bounds = np.r_[starts, len(order)]
        self.low, self.high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        self.first, self.last = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        above = np.arange(0, len(starts), FAN)
        self.parent = np.arange(len(starts)) // FAN
        self.node_low, self.node_high = np.minimum.reduceat(self.low, above), np.maximum.reduceat(self.high, above)

    @staticmethod
    def _packed(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Order of the rows: by label, inside a label sorted and tiled coordinate after coordinate."""
        out: list[np.ndarray] = []

        def tile(rows: np.ndarray, used: tuple[int, ...]) -> None:
            leaves = -(-len(rows) // LEAF)
            spread = np.ptp(vectors[rows], axis=0) if vectors.shape[1] else np.empty(0)
            spread[list(used)] = -1
            axis = int(spread.argmax()) if len(spread) else 0
            if leaves <= 1 or not len(spread) or spread[axis] <= 0:
                out.append(rows)
                return
            axes = min(len(spread) - len(used), max(1, int(np.ceil(np.log2(leaves)))))
            slabs = int(np.ceil(leaves ** (1 / axes)))
            width = -(-leaves // slabs) * LEAF
            ordered = rows[np.argsort(vectors[rows, axis], kind="stable")]
            for at in range(0, len(ordered), width):
                tile(ordered[at : at + width], (*used, axis))

        for label in np.unique(labels):
            tile(np.flatnonzero(labels == label), ())
        return np.concatenate(out)


def _exact_type(largest: float, dimensions: int):
    """The narrowest type in which inner products of such components are exact."""
    bound = largest * largest * max(dimensions, 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with each box, added up by coordinate."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def search(tree: Tree, anchors: np.ndarray, labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, own: np.ndarray, same: bool, k: int):
    """The k best rows of each anchor as (anchor, score, id), best first, ties by id.

    Rows are those of the anchor's label (``same``) or of the others, with a score in
    [low, high]; the anchor's ``own`` id is left out.
    """
    largest = max(float(np.abs(x).max(initial=0)) for x in (tree.vectors.astype(float), anchors.astype(float)))
    kind = _exact_type(largest, anchors.shape[1])
    rows, points = tree.vectors.astype(kind), anchors.astype(kind)
    low, high = tree.low.astype(kind), tree.high.astype(kind)
    count = len(points)
    lows, highs = lows[:, None], highs[:, None]
    label = labels[:, None]
    at_least, at_most = _intervals(points, tree.node_low.astype(kind), tree.node_high.astype(kind))
    open_nodes = (at_most >= lows) & (at_least <= highs)
    at_least, at_most = _intervals(points, low, high)
    open_leaves = open_nodes[:, tree.parent] & (at_most >= lows) & (at_least <= highs)
    if same:
        open_leaves &= (label >= tree.first) & (label <= tree.last)
    else:
        open_leaves &= (label != tree.first) | (label != tree.last)
    bound = np.where(open_leaves, at_most.astype(np.float64), -np.inf)
    queue = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, queue, axis=1)
    kth = np.full(count, -np.inf)
    best = np.empty((0, 3), np.int64)
    taken, width = 0, FIRST_LEAVES
    while taken < queue.shape[1]:
        turn = bound[:, taken : taken + width]
        who, what = np.nonzero((turn > -np.inf) & (turn >= kth[:, None]))
        if not len(who):
            break  # the bounds only fall from here on
        leaf = queue[who, taken + what]
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(leaf)) + 1, len(leaf)]
        found = [best]
        for a, b in zip(cuts, cuts[1:], strict=False):
            asking = who[a:b]
            span = slice(*tree.bounds[leaf[a] : leaf[a] + 2])
            scores = points[asking] @ rows[span].T
            fits = (scores >= lows[asking]) & (scores <= highs[asking]) & (scores >= kth[asking][:, None])
            fits &= ((tree.labels[span] == label[asking]) == same) & (tree.sole[span] != own[asking][:, None])
            found.append(_best_of_leaf(tree, span.start, asking, scores, fits, own, k))
        best = _best(np.concatenate(found), k)
        full = np.flatnonzero(np.bincount(best[:, 0], minlength=count) == k)
        worst = np.full(count, np.inf)
        np.minimum.at(worst, best[:, 0], best[:, 1])
        kth[full] = worst[full]
        taken, width = taken + width, 2 * width
    return best


def _best_of_leaf(tree: Tree, start: int, asking, scores, fits, own, k: int) -> np.ndarray:
    if scores.shape[1] > k and fits.sum() > 4 * k * len(asking):
        # Of many rows that fit only those count that reach the k-th best of this leaf, ties included.
        masked = np.where(fits, scores.astype(np.float64), -np.inf)
        place = masked.shape[1] - k
        fits &= masked >= np.partition(masked, place, axis=1)[:, place][:, None]
    i, j = np.nonzero(fits)
    value = scores[i, j].astype(np.int64)
    sizes = np.fromiter((len(tree.ids[start + x]) for x in j.tolist()), np.int64, len(j))
    flat = np.fromiter((n for x in j.tolist() for n in tree.ids[start + x]), np.int64, int(sizes.sum()))
    out = np.stack([np.repeat(asking[i], sizes), np.repeat(value, sizes), flat], axis=1)
    return out[out[:, 2] != own[out[:, 0]]]


def _best(found: np.ndarray, k: int) -> np.ndarray:
    found = found[np.lexsort((found[:, 2], -found[:, 1], found[:, 0]))]
    # One id may stand in several rows with one score: it counts once.
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]).any(axis=1)
    found = found[fresh]
    begins = np.r_[True, found[1:, 0] != found[:-1, 0]] if len(found) else np.empty(0, bool)
    place = np.arange(len(found)) - np.repeat(np.flatnonzero(begins), np.diff(np.r_[np.flatnonzero(begins), len(found)]))
    return found[place < k]


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, vec): rows with an id, a label and a finite vector, as integers.

    A component x becomes floor(256 * x). Where the id is divisible by 7 the label becomes
    the remainder of label + 1 by 10.
    """
    component = F.col("_given")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("_label"), F.col(vector_column).cast("array<double>").alias("_given"))
    rows = rows.where(F.col("id").isNotNull() & F.col("_label").isNotNull() & component.isNotNull() & F.forall(component, finite))
    label = F.when(F.col("id") % 7 == 0, F.pmod(F.col("_label") + 1, F.lit(10))).otherwise(F.col("_label"))
    return rows.select("id", label.cast("long").alias("label"), F.transform(component, lambda x: F.floor(x * 256.0)).alias("vec"))


def _grouped(rows: DataFrame, ids: int, groups: int) -> tuple[DataFrame, int]:
    """Distinct (vec, label) with their smallest ids, dealt to ``groups`` by dimension, label and first coordinate."""
    small = rows.withColumn("_place", F.dense_rank().over(Window.partitionBy("vec", "label").orderBy("id"))).where(F.col("_place") <= ids)
    distinct = small.groupBy("vec", "label").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    distinct = distinct.withColumn("dim", F.size("vec"))
    ranged = distinct.repartitionByRange(groups, "dim", "label", F.get("vec", F.lit(0)), F.xxhash64("vec"))
    ranged = pin(ranged.withColumn("_part", F.spark_partition_id()))
    parts = ranged.rdd.getNumPartitions()
    group = F.floor(F.col("_part") * F.lit(groups) / F.lit(parts)).cast("int")
    return ranged.withColumn("group", group).drop("_part"), groups


def _mined(rows: DataFrame, anchors: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """(query, score, found) of the k best rows in each group for each anchor sent there.

    ``anchors``: (query, own, vec, label, dim, low, high, group). A task reads the rows of a
    group, builds the tree, then lets the anchors pass in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, trees = None, [], None
        for batch in batches:
            keys = batch.column("group").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                group, kind = divmod(int(keys[a]), 2)
                if group != current:
                    current, held, trees = group, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if trees is None:
                    trees, held = _trees(held), []
                for at in range(0, len(part), BATCH):
                    yield from _asked(trees, part.slice(at, BATCH), same, k)

    empty = F.lit(None)
    data = rows.select("group", F.lit(0).alias("kind"), "dim", "vec", "label", "ids", *(empty.cast("long").alias(c) for c in ("query", "own", "low", "high")))
    asking = anchors.select("group", F.lit(1).alias("kind"), "dim", "vec", "label", empty.cast("array<long>").alias("ids"), "query", "own", "low", "high")
    dealt = data.unionByName(asking).repartitionByRange(groups, "group").sortWithinPartitions("group", "kind")
    return dealt.mapInArrow(run, "query long, score long, found long")


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    flat = batch.column("vec").flatten().to_numpy()
    return flat.reshape(len(batch), dimension)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("dim").to_numpy()
    for dimension in np.unique(sizes).tolist():
        yield dimension, batch.filter(pa.array(sizes == dimension))


def _trees(held: list[pa.RecordBatch]) -> dict[int, Tree]:
    """A tree for each number of components, as only equal ones have an inner product."""
    if not held:
        return {}
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return {
        dimension: Tree(_matrix(rows, dimension), rows.column("label").to_numpy(), rows.column("ids").to_pylist())
        for dimension, rows in _by_dimension(whole)
    }


def _asked(trees: dict[int, Tree], batch: pa.RecordBatch, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    for dimension, part in _by_dimension(batch):
        if dimension not in trees:
            continue
        query, own, label, low, high = (part.column(c).to_numpy() for c in ("query", "own", "label", "low", "high"))
        best = search(trees[dimension], _matrix(part, dimension), label, low, high, own, same, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query[best[:, 0]]), pa.array(best[:, 1]), pa.array(best[:, 2])], names=["query", "score", "found"]
        )


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all groups, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _spans(rows: DataFrame, *keys: str) -> DataFrame:
    """First and last group of each key; groups follow the order of the keys."""
    return rows.groupBy(*keys).agg(F.min("group").alias("_from"), F.max("group").alias("_to"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int, int] = (50, 95, 100),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels inside a score window.

    An anchor's positives are the ``positives`` best other rows of its label. A negative has a
    score n with low * p <= scale * n <= high * p for the positive's score p and
    ``window`` = (low, high, scale); the best ``negatives`` of these are returned as
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), higher scores
    first, ties by the smaller id. ``anchor`` is a condition on the column ``id``; the
    default takes ids divisible by 50.

    Rows without an id, a label or a whole finite vector take no part; only vectors of equally
    many components are compared. A repeated row counts once; of rows that share an id
    but not the content each is a row, but none is another row to the others. An anchor
    without positives or negatives yields nothing, and so does an empty table. Other columns
    are left out. Scores are exact; sums beyond 64 bits are not supported. Equal vectors of one
    label are searched once: only their ``positives`` + 1 smallest ids can be among the first.
    """
    spark = vectors.sparkSession
    low, high, scale = window
    rows = usable(vectors, id_column, vector_column, label_column)
    total = vectors.count()
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-total // group_rows))
    tree_rows, groups = _grouped(rows, max(positives, negatives) + 1, groups)
    chosen = rows.where(F.col("id") % 50 == 0 if anchor is None else anchor).distinct()
    chosen = pin(chosen.withColumn("dim", F.size("vec")).withColumn("query", F.monotonically_increasing_id()))

    def sent(asking: DataFrame, *keys: str) -> DataFrame:
        met = asking.join(_spans(tree_rows, *keys), list(keys))
        return met.withColumn("group", F.explode(F.sequence("_from", "_to")))

    everything = {"own": F.col("id"), "low": F.lit(LEAST), "high": F.lit(MOST)}
    near = _first(_mined(tree_rows, sent(chosen.withColumns(everything), "dim", "label"), groups, True, positives), positives)
    near = pin(near.select(F.col("query").alias("anchor"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id")))
    # low * p <= scale * n <= high * p, rounded to whole n.
    score = F.col("positive_score")
    least = F.expr(f"-floor(-({low} * positive_score) / {scale})") if scale != 1 else score * low
    most = F.expr(f"floor(({high} * positive_score) / {scale})") if scale != 1 else score * high
    asked = near.select("anchor", "positive_score", least.cast("long").alias("low"), most.cast("long").alias("high")).distinct().where("low <= high")
    asked = pin(asked.withColumn("query", F.monotonically_increasing_id()))
    known = chosen.withColumnRenamed("query", "anchor").withColumnRenamed("id", "own")
    far = _first(_mined(tree_rows, sent(asked.join(known, "anchor"), "dim"), groups, False, negatives), negatives)
    far = far.join(asked.select("query", "anchor", "positive_score"), "query")
    result = near.join(far, ["anchor", "positive_score"]).join(chosen.select(F.col("query").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_inner_product(a.vec, r.vec)::bigint as score
  from usable a join usable r on a.vec_id <> r.vec_id
  where a.vec_id % 50 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
fitting as (
  select p.*, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as place
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, place::int as rank, negative_id, positive_score, negative_score
from fitting where place <= 3"""
