"""Hard negatives by inner product, searched in R-trees that are packed sort-tile-recursively.

Rows are dealt into tiles by range of label and of the widest coordinates. Inside a tile they are packed into leaves by
sorting along one axis after the other, and a tree of minimum bounding boxes is built over the leaves. For an anchor q a
box [lo, hi] bounds every inner product in it: coordinate by coordinate q*lo and q*hi are the ends of an interval. A
best-first queue opens the box with the highest bound first and passes over boxes whose interval misses the score window
or whose bound lies strictly below the k-th score found so far.

Anchors are rows of the table themselves, so they travel in blocks: each task searches one tile for one block of anchors and
returns the best of the tile, a few rows per anchor, which are then merged by anchor. Nothing passes through the driver and
no pair of rows is ever written out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import held, ship

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class MinePlan:
    """``floor``: a negative scores at least this percentage of the positive."""

    positives: int = 5
    negatives: int = 5
    floor: int = 80
    tile_rows: int = 8192
    block_rows: int = 2048  # anchors of a block
    leaf: int = 64
    fan: int = 8
    axes: int = 3  # coordinates that rows are dealt by


@dataclass
class Tree:
    """Rows in leaf order; ``lo``, ``hi`` and the range of labels of each node; ``kids`` of a node, or its rows."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    lo: list[np.ndarray] = field(default_factory=list)
    hi: list[np.ndarray] = field(default_factory=list)
    labels_lo: list[int] = field(default_factory=list)
    labels_hi: list[int] = field(default_factory=list)
    kids: list[tuple[int, ...]] = field(default_factory=list)
    rows: list[tuple[int, int]] = field(default_factory=list)
    place: np.ndarray | None = None  # of a row in the order of ids

    def add(self, lo, hi, low, high, kids=(), rows=(0, 0)) -> int:
        for values, value in zip((self.lo, self.hi, self.labels_lo, self.labels_hi, self.kids, self.rows), (lo, hi, low, high, kids, rows)):
            values.append(value)
        return len(self.lo) - 1


def tiled(keys: list[np.ndarray], leaf: int) -> np.ndarray:
    """Sort-tile-recursive order: slabs along the first key, each packed along the others."""

    def pack(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        rows = rows[np.argsort(keys[depth][rows], kind="stable")]
        if depth == len(keys) - 1 or len(rows) <= leaf:
            return [rows]
        # As many slabs as leave equal shares to the axes that follow; whole leaves each.
        slabs = math.ceil(math.ceil(len(rows) / leaf) ** (1 / (len(keys) - depth)))
        size = leaf * math.ceil(math.ceil(len(rows) / leaf) / slabs)
        return [part for at in range(0, len(rows), size) for part in pack(rows[at:at + size], depth + 1)]

    return np.concatenate(pack(np.arange(len(keys[0])), 0))


def build_tree(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, plan: MinePlan = MinePlan()) -> Tree:
    """Tree over the rows of a tile. Rows are ordered by id before packing, so equal vectors stay in that order."""
    by_id = np.lexsort((ids,))
    ids, labels, x = ids[by_id], labels[by_id], x[by_id]
    widest = np.argsort(-x.astype(float).var(0), kind="stable")[:plan.axes] if x.shape[1] else []
    order = tiled([labels, *(x[:, k] for k in widest)], plan.leaf)
    tree = Tree(ids[order], labels[order], x[order])
    tree.place = np.argsort(np.argsort(tree.ids, kind="stable"), kind="stable")
    level = []
    for at in range(0, len(order), plan.leaf):
        rows = slice(at, min(at + plan.leaf, len(order)))
        level.append(tree.add(tree.x[rows].min(0), tree.x[rows].max(0), tree.labels[rows].min(), tree.labels[rows].max(), (), (rows.start, rows.stop)))
    while len(level) > 1:
        above = []
        for at in range(0, len(level), plan.fan):
            kids = level[at:at + plan.fan]
            above.append(tree.add(
                np.min([tree.lo[k] for k in kids], 0), np.max([tree.hi[k] for k in kids], 0),
                min(tree.labels_lo[k] for k in kids), max(tree.labels_hi[k] for k in kids), tuple(kids)))
        level = above
    return tree


def _exact(*parts: np.ndarray) -> bool:
    """Whether sums of products of the parts are exact in doubles, with room for the order of ids behind them."""
    dims = max(parts[0].shape[1], 1)
    return dims * math.prod(float(np.abs(p).max(initial=0)) + 1 for p in parts) < 2**46


def search(
    tree: Tree, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, k: int, *, same: bool,
    low: np.ndarray | None = None, high: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, row ids, scores): the first ``k`` rows of the tile for each query, by score and then by smaller id.

    ``same``: only rows of the query's label, or only rows of another. ``low`` and ``high`` bound the scores, inclusively.
    A row whose id is the query's is never returned. Products that doubles
    do not hold exactly are taken in whole numbers, and scores beyond 64 bits are held at the bound.
    """
    n, m = len(tree.ids), len(q)
    if not n or not m:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    kind = float if _exact(q, tree.x) else object
    q, x = q.astype(kind), tree.x.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low = np.full(m, None) if low is None else low.astype(object)
    # A key holds score and place in the order of ids, so that keys are distinct: score * n + (n - 1 - place).
    number = np.int64 if kind is float else object
    floor_key = _LEAST if kind is float else -(1 << 400)
    best = np.full((m, k), floor_key, number)
    least = np.array([floor_key if v is None else int(v) * n for v in low], object)
    most = np.array([1 << 400] * m if high is None else [(int(v) + 1) * n for v in high], object)
    if number is np.int64:
        least, most = (np.clip(v, _LEAST, _MOST).astype(np.int64) for v in (least, most))
    turned = n - 1 - tree.place

    def whole(products: np.ndarray) -> np.ndarray:
        return products.astype(np.int64) if kind is float else np.minimum(np.maximum(products, _LEAST), _MOST)

    boxes_lo, boxes_hi = np.array(tree.lo).astype(kind), np.array(tree.hi).astype(kind)
    labels_lo, labels_hi = np.array(tree.labels_lo), np.array(tree.labels_hi)
    everyone = np.arange(m)
    # (highest bound first, node, queries that want it, their bounds)
    queue: list[tuple[object, int, np.ndarray, np.ndarray]] = [(0, len(tree.lo) - 1, everyone, most)]
    while queue:
        _, node, who, bound = heapq.heappop(queue)
        # The k-th score may have risen since the node was put into the queue.
        who = who[bound >= best[who].min(1)]
        if not len(who):
            continue
        if tree.kids[node]:
            kids = list(tree.kids[node])
            lo, hi = boxes_lo[kids].T, boxes_hi[kids].T
            top = whole(up[who] @ hi + down[who] @ lo) * n + (n - 1)
            bottom = whole(up[who] @ lo + down[who] @ hi) * n
            own = q_labels[who][:, None]
            if same:
                fits = (labels_lo[kids] <= own) & (own <= labels_hi[kids])
            else:
                fits = (labels_lo[kids] != own) | (own != labels_hi[kids])
            floor = np.maximum(best[who].min(1), least[who])
            fits &= (top >= floor[:, None]) & (bottom < most[who][:, None])
            capped = np.minimum(top, most[who][:, None])
            for at, kid in enumerate(kids):
                wanted = fits[:, at]
                if wanted.any():
                    bound = capped[wanted, at]
                    heapq.heappush(queue, (-int(bound.max()), kid, who[wanted], bound))
            continue
        rows = slice(*tree.rows[node])
        keys = whole(q[who] @ x[rows].T) * n + turned[rows]
        match = tree.labels[rows] == q_labels[who][:, None]
        fits = (match if same else ~match) & (tree.ids[rows] != q_ids[who][:, None])
        fits &= (keys >= least[who][:, None]) & (keys < most[who][:, None]) & (keys > best[who].min(1)[:, None])
        hit = fits.any(1)
        if hit.any():
            who, keys = who[hit], np.where(fits[hit], keys[hit], floor_key)
            best[who] = np.sort(np.concatenate([best[who], keys], 1), 1)[:, -k:]
    asked, column = np.nonzero(best > floor_key)
    keys = best[asked, column]
    by_place = np.argsort(tree.place, kind="stable")
    return asked, tree.ids[by_place[(n - 1 - keys % n).astype(np.int64)]], (keys // n).astype(np.int64)


_BLOB = "part int, n int, dims int, width int, ids binary, labels binary, x binary, high binary"


def _packed(rows: DataFrame, dims: int, most: int) -> DataFrame:
    """Rows (vec_id, label, x, high) of each partition as matrices of at most ``most`` rows, numbered by partition."""

    def pack(ids, labels, lists, highs, part) -> pa.RecordBatch:
        x = np.zeros((len(ids), dims), np.int64)
        for k, values in enumerate(lists):
            x[k, :len(values)] = values
        # Whole numbers as narrow as they fit.
        width = next(w for w in (2, 4, 8) if not x.size or w == 8 or (x.min() >= -(1 << 8 * w - 1) and x.max() < 1 << 8 * w - 1))
        blobs = [np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(),
                 x.astype(f"i{width}").tobytes(), np.array(highs, np.int64).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int32()) for v in (part, len(ids), dims, width)] + [pa.array([b], pa.binary()) for b in blobs],
            ["part", "n", "dims", "width", "ids", "labels", "x", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list] = [[], [], [], []]
        part = 0
        for batch in batches:
            part = batch.column(4)[0].as_py() if batch.num_rows else part
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for values, value in zip(waiting, row):
                    values.append(value)
                if len(waiting[0]) >= most:
                    yield pack(*waiting, part)
                    waiting = [[], [], [], []]
        if waiting[0]:
            yield pack(*waiting, part)

    return rows.select("vec_id", "label", "x", "high", F.spark_partition_id().alias("part")).mapInArrow(run, _BLOB)


def _unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for r in table.select(["n", "dims", "width", "ids", "labels", "x", "high"]).to_pylist():
        of = lambda name: np.frombuffer(r[name], np.int64)
        yield of("ids"), of("labels"), np.frombuffer(r["x"], f"i{r['width']}").reshape(r["n"], r["dims"]).astype(np.int64), of("high")


class _Packed:
    """Blocks written to the scratch folder and how many numbers their parts take."""

    def __init__(self, rows: DataFrame, count: int, most: int, dims: int, order: list[Column], label: str):
        spread = rows.repartitionByRange(max(1, math.ceil(count / most)), *order)
        self.rows = held(_packed(spread, dims, most), label)
        self.parts = (self.rows.agg(F.max("part")).first()[0] or 0) + 1


def _searched(tiles: _Packed, asked: _Packed, plan: MinePlan, same: bool) -> DataFrame:
    """(anchor_id, high, vec_id, score): the best rows of every tile for every query of every block."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spark = tiles.rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = tiles.rows.withColumns({"tile": F.col("part"), "block": numbers(asked.parts)}).repartition(parts, "tile", "block")
    right = asked.rows.withColumns({"block": F.col("part"), "tile": numbers(tiles.parts)}).repartition(parts, "tile", "block")

    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for ids, labels, x, _ in _unpacked(tile) if block.num_rows else ():
            tree = build_tree(ids, labels, x, plan)
            for q_ids, q_labels, q, high in _unpacked(block):
                if same:
                    whose, found, scores = search(tree, q, q_ids, q_labels, plan.positives, same=True)
                else:
                    low = np.array([-(-plan.floor * int(h) // 100) for h in high], object)
                    whose, found, scores = search(tree, q, q_ids, q_labels, plan.negatives, same=False, low=low, high=high)
                for values, value in zip(columns, (q_ids[whose], high[whose], found, scores)):
                    values.append(value)
        return pa.table({name: np.concatenate(values) for name, values in zip(("anchor_id", "high", "vec_id", "score"), columns)})

    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(
        run, "anchor_id bigint, high bigint, vec_id bigint, score bigint")


def points(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, x: rows with a vector of finite components, each taken as floor(scale * component).

    Rows with a null id, label, vector or component, or with one that is not finite, take no part. Of several rows with one
    id the least by label, then vector, stands for all. Components beyond 64 bits are held at the bound.
    """
    parts = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    whole = F.transform(parts, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    kept = rows.where(valid).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(
        F.col("label").cast("bigint").alias("label"), whole.alias("x")).alias("r"))
    return kept.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.x")


def hard_negatives(rows: DataFrame, anchor: Column, plan: MinePlan = MinePlan()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is what ``points`` returns, ``anchor`` marks the anchors among them. A row's score is its inner product with the
    anchor; higher ones come first, ties by smaller id. An anchor's positives are its first rows of the same label, and for
    each of them the first rows of other labels that score at least ``floor`` percent of the positive and at most as much
    are its negatives. An anchor without positives, or a positive without negatives (any with a score below 0), has no row.
    Vectors of different length are filled up with zeros; scores beyond 64 bits are held at the bound. An empty table gives
    no rows.
    """
    ship(rows.sparkSession)
    kept = held(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))), "points")
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("x")).alias("dims")).first()
    dims = size.dims or 0
    # A few rows say which coordinates are wide. Only the layout of tiles follows from them, no result.
    few = [r.x for r in kept.select("x").limit(1024).collect()]
    some = np.array([[*x, *[0] * (dims - len(x))] for x in few], float).reshape(len(few), dims)
    widest = np.argsort(-some.var(0), kind="stable")[:plan.axes].tolist() if few else []
    order = [F.col("label"), *(F.get("x", F.lit(k)) for k in widest), F.col("vec_id")]

    none = F.lit(0).cast("bigint").alias("high")
    tiles = _Packed(kept.select("vec_id", "label", "x", none), size.n, plan.tile_rows, dims, order, "tiles")
    anchors = kept.where("anchor").select("vec_id", "label", "x")
    asked = _Packed(anchors.select("*", none), size.anchors, plan.block_rows, dims, order, "anchors")
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))
    positives = held(
        _searched(tiles, asked, plan, same=True).withColumn("_n", first(["anchor_id"])).where(F.col("_n") <= plan.positives).select(
            "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = positives.select(F.col("anchor_id").alias("vec_id"), F.col("positive_score").alias("high")).distinct()
    windows = _Packed(anchors.join(windows, "vec_id"), size.anchors * plan.positives, plan.block_rows, dims, [*order, F.col("high")], "windows")
    negatives = _searched(tiles, windows, plan, same=False).withColumn(
        "rank", first(["anchor_id", "high"])).where(F.col("rank") <= plan.negatives)
    named = negatives.select(
        "anchor_id", F.col("high").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(named, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
