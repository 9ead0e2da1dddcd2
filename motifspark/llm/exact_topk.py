"""Exact top-k search by inner product: a KD-tree in each shard.

The same median splits, fitted on a bounded sample (``SAMPLE`` vectors), first cut the space
into at most ``CELLS`` cells; each vector goes to its cell, and a cell of more than ``shard_rows``
vectors to as many shards, by a hash of the row, so that equal vectors are no large shard. All
vectors are indexed; the sample only says where cells end. Each cell has a tight bounding box.

A shard builds one KD-tree: median splits on the widest dimension, tight bounding boxes. A query
walks a tree best-first: a box's bound is the largest inner product that any point in it could
have, and the traversal stops when the best open box cannot beat the query's k-th score. A first
pass searches one shard of each query's own cell; its k-th score then tells which cells' boxes can
hold better ones, and the query goes to their shards alone, with that score, so that most trees
are cut near the root.

Defined cases: vectors null, empty, or holding null or non-finite components take no part
(neither as query nor candidate), nor do rows of null id. Only vectors of equal length are
compared. A candidate of a query is every row but the query's own: rows that repeat its id, or
its id and components, are candidates and queries of their own. Fewer candidates than k: all
are returned. Ties go to the smaller id. Empty tables give no rows. Other columns of the input
are ignored, whatever their names. Components stop at the ends of a long; inner products that
leave 53 bits are worked out in Python integers, and one beyond a long counts as the nearest
long. Vectors of any length are compared whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, written

LEAF = 128
SAMPLE, CELLS = 16_384, 4096
SAFE = float(2**52)


class KdTree:
    """Points sorted into nodes: arrays of boxes, children, and slices of points."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, whole: np.ndarray, leaf: int = LEAF):
        points = whole.astype(np.float64)
        self.lo, self.hi, self.kids, self.slice, self.least = [], [], [], [], []
        order = np.arange(len(ids))
        # Within equal components the smaller ids come first.
        order = order[np.argsort(ids, kind="stable")]
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            me = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.least.append(ids[order[a:b]].min())
            self.slice.append((a, b))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = me
            if b - a > leaf:
                d = int(np.argmax(hi - lo))
                mid = (b - a) // 2
                cut = np.argpartition(own[:, d], mid) if hi[d] > lo[d] else np.arange(b - a)
                order[a:b] = order[a:b][cut]
                stack += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.ids, self.rows, self.points, self.whole = ids[order], rows[order], points[order], whole[order]
        self.top = float(np.abs(self.points).max())

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product each box admits: queries x nodes."""
        pos, neg = np.maximum(queries, 0), np.minimum(queries, 0)
        return pos @ self.hi.T + neg @ self.lo.T

    def search(self, query: np.ndarray, own: int, k: int, bound: np.ndarray, floor: float, exact: bool):
        """At most k (score, id) that beat or equal ``floor``, best first; the row ``own`` takes no part."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        open_ = [(-bound[0], 0)]
        near = query.astype(np.float64) if exact else None
        while open_:
            b, node = heapq.heappop(open_)
            kth = best[0][0] if len(best) == k else floor
            if -b < kth:
                break
            if len(best) == k and -b == kth and self.least[node] > -best[0][1]:
                continue
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(open_, (-bound[left], left))
                heapq.heappush(open_, (-bound[right], right))
                continue
            x, y = self.slice[node]
            if exact:
                scores = self.points[x:y] @ near
                keep = np.flatnonzero((scores >= kth) & (self.rows[x:y] != own))
            else:
                scores = [_long(sum(int(p) * int(q) for p, q in zip(row, query))) for row in self.whole[x:y]]
                keep = [i for i, s in enumerate(scores) if s >= kth and self.rows[x + i] != own]
            for i in keep:
                item = (float(scores[i]) if exact else scores[i], -int(self.ids[x + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def quantise(col: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(col, lambda x: F.floor(x.cast("double") * scale))
    return F.when((F.size(col) > 0) & ~bad, whole)


class Cells:
    """Median splits of sampled points: a full binary tree whose leaves are cells, numbered from ``first``."""

    def __init__(self, points: np.ndarray, most: int, first: int):
        self.depth, self.first = max(0, most.bit_length() - 1), first
        self.dims, self.cuts = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        groups = [points]
        for node in range(len(self.dims)):
            own = groups[node]
            d = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            self.dims[node], self.cuts[node] = d, np.median(own[:, d]) if len(own) else 0
            low = own[:, d] < self.cuts[node]
            groups += [own[low], own[~low]]

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dims[at]] >= self.cuts[at])
        return at - len(self.dims) + self.first


def fitted(base: DataFrame, n: int, shard_rows: int) -> dict[int, Cells]:
    """The cells, for each length of vectors that the sample has; about a cell for every ``shard_rows`` vectors, ``CELLS`` at most."""
    draw = F.pmod(F.xxhash64(F.lit(5), "vid", "v"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, n)))
    table = base.filter(draw).select("v").limit(2 * SAMPLE).toArrow()
    by: dict[int, list[np.ndarray]] = {}
    for batch in table.to_batches():
        for _, x in _matrices(batch, "v"):
            by.setdefault(x.shape[1], []).append(x.astype(np.float64))
    out, first = {}, 1  # cell 0 is that of lengths the sample lacks
    for d, found in sorted(by.items()):
        own = np.concatenate(found)
        out[d] = Cells(own, max(1, min(CELLS, -(-n // shard_rows)) * len(own) // table.num_rows), first)
        first += 1 << out[d].depth
    return out


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each length in a batch."""
    lists = batch.column(batch.schema.get_field_index(column))
    ends = lists.offsets.to_numpy()
    flat, lens = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for d in np.unique(lens):
        at = np.flatnonzero(lens == d)
        yield at, flat[ends[at][:, None] + np.arange(d)]


def _celled(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = np.zeros(batch.num_rows, np.int64)
        for at, x in _matrices(batch, "v"):
            if x.shape[1] in cells:
                cell[at] = cells[x.shape[1]].of(x.astype(np.float64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's boxes: cell, length, lo, hi, n."""
    boxes: dict[tuple[int, int], list] = {}
    for batch in batches:
        cell = batch.column(1).to_numpy()
        for at, x in _matrices(batch, "v"):
            for c in np.unique(cell[at]):
                own = x[cell[at] == c]
                box = boxes.setdefault((int(c), x.shape[1]), [own[0], own[0], 0])
                box[:] = np.minimum(box[0], own.min(axis=0)), np.maximum(box[1], own.max(axis=0)), box[2] + len(own)
    if boxes:
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        rows = [(c, d, lo.tolist(), hi.tolist(), n) for (c, d), (lo, hi, n) in boxes.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["cell", "length", "lo", "hi", "n"])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi = np.stack(list(pdf["lo"])).min(axis=0), np.stack(list(pdf["hi"])).max(axis=0)
    return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "length": pdf["length"].iloc[:1], "lo": [lo], "hi": [hi], "n": [pdf["n"].sum()]})


def _visits(batches: Iterator[pa.RecordBatch], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Each query (row, vid, v, floor) with every shard of every cell whose box may hold a score of ``floor`` or more."""
    for batch in batches:
        floor = batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        for at, x in _matrices(batch, "v"):
            lo, hi, first, shards = boxes[x.shape[1]]
            x = x.astype(np.float64)
            for k in range(0, len(at), 64):
                own = x[k : k + 64]
                bound = np.maximum(own, 0) @ hi.T + np.minimum(own, 0) @ lo.T
                slack = np.abs(own) @ np.maximum(np.abs(lo), np.abs(hi)).T * 1e-9 + 1  # round-off must not cut a box
                q, c = np.nonzero(np.minimum(bound + slack, 2.0**63) >= floor[at[k : k + 64], None])
                take = pa.array(np.repeat(at[k + q], shards[c]))
                shard = np.repeat(first[c] - np.cumsum(shards[c]) + shards[c], shards[c]) + np.arange(shards[c].sum())
                rows = batch.take(take)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shard)], names=["row", "vid", "v", "floor", "shard"])


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024, shard_rows: int = 8192, block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest integer inner products."""
    spark = vectors.sparkSession
    base = vectors.select(
        F.col(id_col).cast("long").alias("vid"), quantise(F.col(vector_col), scale).alias("v"), is_query.alias("q")
    ).filter("v is not null and vid is not null")
    cells = fitted(base, vectors.count(), shard_rows)
    # A row's number is written with it, so that it is the same wherever the row is read.
    numbered = base.select("vid", "v", F.coalesce("q", F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
    base = written(numbered.mapInArrow(lambda it: _celled(it, cells), "vid long, v array<long>, q boolean, row long, cell long"), "topk-vectors")
    boxes = base.select("v", "cell").mapInArrow(_boxes, "cell long, length int, lo array<long>, hi array<long>, n long")
    boxes = boxes.groupBy("cell", "length").applyInPandas(_merged, "cell long, length int, lo array<long>, hi array<long>, n long").orderBy("cell", "length").toArrow()  # some CELLS rows
    cell, length, n = (boxes.column(c).to_numpy() for c in ("cell", "length", "n"))
    shards = -(-n // shard_rows)
    firsts = np.cumsum(shards) - shards
    corners = {d: tuple(np.stack(boxes.column(c).to_pandas()[length == d].tolist()).astype(np.float64) for c in ("lo", "hi")) for d in np.unique(length).tolist()}
    known = {d: (*corners[d], firsts[length == d], shards[length == d]) for d in corners}
    rows = list(zip(cell.tolist(), length.tolist(), firsts.tolist(), shards.tolist()))
    of = F.broadcast(spark.createDataFrame(rows, "cell long, length int, first long, shards long"))  # some CELLS rows
    deal = lambda salt: F.col("first") + F.pmod(F.xxhash64(F.lit(salt), "row"), F.col("shards"))
    dealt = base.withColumn("length", F.size("v")).join(of, ["cell", "length"])
    none = F.lit(None).cast("double").alias("floor")
    points = dealt.select(deal(11).alias("shard"), F.lit(0).alias("side"), "row", "vid", "v", none)
    queries = dealt.filter("q").select("row", "vid", "v", deal(13).alias("shard"))
    total = int(shards.sum())

    def run(side: DataFrame) -> DataFrame:
        # One shuffle brings a shard's points and the queries that visit it together.
        both = points.unionByName(side.select("shard", F.lit(1).alias("side"), "row", "vid", "v", "floor"))
        sent = both.repartition(max(1, min(parts(spark, 1) * 4, total)), "shard").sortWithinPartitions("shard", "side", "row")
        return sent.mapInPandas(lambda it: _search(it, k, block), "row long, query_id long, vec_id long, score long")

    seed = queries.select("row", "vid", "v", "shard", none)
    if total > 1:
        kth = run(seed).groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
        asked = queries.select("row", "vid", "v").join(kth.select("row", F.col("kth").cast("double").alias("floor")), "row", "left").select("row", "vid", "v", "floor")
        found = run(asked.mapInArrow(lambda it: _visits(it, known), "row long, vid long, v array<long>, floor double, shard long"))
    else:
        found = run(seed)
    # Spark keeps k rows a query in each task before the shuffle (a window group limit).
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(batches: Iterator[pd.DataFrame], k: int, block: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard, points first: build that shard's trees, then answer its queries."""
    shard, rows, trees = None, [], None
    for pdf in batches:
        for s, own in pdf.groupby("shard", sort=False):
            if s != shard:
                shard, rows, trees = s, [], None
            pts = own[own["side"] == 0]
            if len(pts):
                rows.append(pts[["vid", "row", "v"]])
            ask = own[own["side"] == 1]
            if len(ask):
                if trees is None:
                    trees = _trees(rows)
                    rows = []
                for i in range(0, len(ask), block):
                    out = _answer(trees, ask.iloc[i : i + block], k)
                    if len(out):
                        yield out


def _trees(rows: list[pd.DataFrame]) -> dict[int, KdTree]:
    """A tree for each length of vectors."""
    if not rows:
        return {}
    every = pd.concat(rows)
    return {d: KdTree(own["vid"].to_numpy(np.int64), own["row"].to_numpy(np.int64), np.stack(list(own["v"])).astype(np.int64)) for d, own in every.groupby(every["v"].map(len))}


def _answer(trees: dict[int, KdTree], ask: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    for d, own in ask.groupby(ask["v"].map(len)):
        tree = trees.get(d)
        if tree is None:
            continue
        whole = np.stack(list(own["v"])).astype(np.int64)
        qs = whole.astype(np.float64)
        bounds = tree.bounds(qs)
        top = tree.top * float(np.abs(qs).max()) * d
        exact = top < SAFE
        if not exact:  # round-off must not cut a box
            bounds = bounds + np.abs(bounds) * 1e-9 + top * 1e-12
        for j, (row, vid, floor) in enumerate(zip(own["row"], own["vid"], own["floor"])):
            low = -np.inf if floor is None or floor != floor else float(floor) - (0 if exact else abs(float(floor)) * 1e-9)
            out += [(row, vid, i, int(s)) for s, i in tree.search(whole[j], row, k, bounds[j], low, exact)]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])
