"""Counting the triangles of a graph without labels by parts of its vertex ranges.

The vertices are cut by id into ranges, and the edges between each two ranges are counted. A part is
three ranges, equal ones too: it receives the edges between them and counts the triangles with a
vertex in each. Where ids lie close to their neighbours', few ranges share edges, so few parts are
made and an edge travels some times; where ids say nothing of neighbourhood, it travels to as many
parts as there are ranges. The number of ranges is the one that sends least while no part is large,
by the counts. No pair of neighbours is ever a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Edges of a part at most, if some number of ranges allows it.
PART = 8_000_000
#: Ranges that are counted, and numbers of ranges that they are joined to.
FINE = 256
RANGES = [*range(1, 33), 40, 48, 64, 96, 128, 192, 256]
#: Ends of paths and marks that are held at once.
ENDS, MARKS = 1_000_000, 16_000_000


def count(edges: DataFrame) -> DataFrame:
    """embeddings: six for each triangle; ``edges`` (u, v), u < v, may repeat."""
    spark = edges.sparkSession
    path = scratch(spark, "later")
    lists = edges.repartition("u").groupBy("u").agg(F.array_sort(F.array_distinct(F.collect_list("v"))).alias("nbrs"))
    lists.write.parquet(path)
    later = spark.read.schema(lists.schema).parquet(path)
    low = later.agg(F.min("u")).first()[0]
    fine = [] if low is None else sorted({int(x) for x in later.approxQuantile("u", [i / FINE for i in range(1, FINE)], 0.2 / FINE)} - {low})
    fine = np.array([low or 0, *fine], np.int64)  # where ranges begin

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(fine) ** 2, np.int64)
        for u, v in map(ends, batches):
            n += np.bincount(between(fine, u) * len(fine) + between(fine, v), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    sizes = np.zeros((len(fine), len(fine)), np.int64)
    for pair, n in later.mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        sizes[divmod(pair, len(fine))] = n
    first, parts = planned(sizes, PART)
    starts, asked = fine[first], defaultdict(list)
    for part in parts:
        for pair in pairs(*part):
            asked[pair].append(part)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in map(ends, batches):
            p, q = between(starts, u), between(starts, v)
            pair = (p * len(starts) + q).astype(np.uint16)
            order = np.argsort(pair, kind="stable")
            cut = np.flatnonzero(np.diff(pair[order], prepend=-1, append=-1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = order[a:b]
                x, y = int(p[own[0]]), int(q[own[0]])
                if to := asked.get((x, y)):
                    cols = [pa.array(c, pa.int32()) for c in zip(*to)] + [pa.array([z] * len(to), pa.int32()) for z in (x, y, b - a)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([packed(u[own] - starts[x], v[own] - starts[y])] * len(to), pa.binary())], ["a", "b", "c", "p", "q", "n", "edges"])

    def counted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [closed(tuple(map(int, key)), lambda p, q: unpacked(pdf["edges"][(pdf["p"] == p) & (pdf["q"] == q)]))]})

    sent = later.mapInArrow(deal, "a int, b int, c int, p int, q int, n int, edges binary")
    found = sent.groupBy("a", "b", "c").applyInPandas(counted, "n long")
    return found.agg((F.coalesce(F.sum("n"), F.lit(0)) * 6).cast("long").alias("embeddings"))


def ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a batch of lists."""
    nbrs = batch.column(1)
    return np.repeat(batch.column(0).to_numpy(), np.diff(nbrs.offsets.to_numpy())), nbrs.flatten().to_numpy()


def between(starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The range of each id."""
    return np.searchsorted(starts, ids, "right") - 1


def pairs(a: int, b: int, c: int) -> set[tuple[int, int]]:
    """The ranges between which a part needs the edges."""
    return {(a, b), (a, c), (b, c)} if a < b < c else {(a, c), (b, b)}


def planned(sizes: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The ranges' first fine ranges, and the parts (a <= b <= c). ``sizes``: edges between fine ranges, from the lower to the higher.

    Of the numbers of ranges by which no part has more than ``most`` edges the one that sends fewest; if there is none, the one with the smallest largest part.
    """
    weight = np.cumsum(sizes.sum(0) + sizes.sum(1))

    def parted(k: int):
        first = np.unique(np.append(0, np.searchsorted(weight, weight[-1] * np.arange(1, k) / k, "right")))
        first = first[first < len(sizes)]
        return first, np.add.reduceat(np.add.reduceat(sizes, first, 0), first, 1)

    def of(n: np.ndarray, a: int):
        """b, c and edges of the parts whose first range is a, of those that can have triangles; n is 0 where c < b."""
        own, all_b = n[a] + n[a][:, None] + n, np.arange(len(n))
        own[a] = n[a, a] + n[a]  # a == b < c
        own[all_b, all_b] = n[a] + n[all_b, all_b]  # a < b == c
        own[a, a] = n[a, a]
        b, c = np.nonzero((n[a] > 0) & (n[a][:, None] > 0) & (n > 0))
        return b, c, own[b, c]

    best = None
    for k in RANGES:
        first, n = parted(k)
        own = np.concatenate([of(n, a)[2] for a in range(len(n))])
        cost = (max(int(own.max(initial=0)), most), int(own.sum()))
        if best is None or cost < best[0]:
            best = cost, k
    first, n = parted(best[1])
    return first, [(a, b, c) for a in range(len(n)) for b, c in zip(*(x.tolist() for x in of(n, a)[:2]))]


def packed(u: np.ndarray, v: np.ndarray) -> bytes:
    """Edges in few bytes: each u once, with its number of edges; differences of 1 to 8 bytes, first bytes first, which then compress."""
    at = np.flatnonzero(np.diff(u, prepend=u[0] + 1))
    out = []
    for x in (u[at], np.diff(at, append=len(u)), v):
        d = np.diff(x, prepend=0)
        d = ((d << 1) ^ (d >> 63)).view(np.uint64)
        width = max(1, (int(d.max()).bit_length() + 7) // 8)
        out += [np.array([len(d), width], np.int64).tobytes(), d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpacked(blobs) -> tuple[np.ndarray, np.ndarray]:
    """All edges of some ``packed``, u and v."""
    us, vs = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for blob in blobs:
        at, own = 0, []
        for _ in range(3):
            n, width = np.frombuffer(blob, np.int64, 2, at).tolist()
            d = np.zeros((n, 8), np.uint8)
            d[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 16).reshape(width, n).T
            d = d.reshape(-1).view("<u8")
            x = np.cumsum((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64))
            own.append(x.astype(np.int32) if 0 <= x.min() and x.max() < 1 << 31 else x)
            at += 16 + n * width
        us.append(np.repeat(own[0], own[1]))
        vs.append(own[2])
    return np.concatenate(us), np.concatenate(vs)


def closed(part: tuple[int, int, int], edges) -> int:
    """Triangles with a vertex in each range of the part; ``edges(p, q)``: the edges from range p to q."""
    a, b, c = part
    if a < b < c:
        (x, y), (own, to), (own_y, to_y) = edges(a, b), edges(a, c), edges(b, c)
        n, x, own = numbered(x, own)
        _, y, own_y = numbered(y, own_y)
        own, to = np.concatenate([own, own_y + n]), np.concatenate([to, to_y])
        y = y + n
    else:  # two vertices in b; with a third one in a or c, or later in b
        x, y = edges(b, b)
        own, to = (x, y) if a == c else edges(a, c) if a == b else edges(a, c)[::-1]
        _, x, y, own = numbered(x, y, own)
    width, to = numbered(to)
    return common(x, y, own, to, width)


def numbered(*ids: np.ndarray) -> tuple:
    """A number above all, and the ids as numbers in proportion to how many there are."""
    low, high = min(int(x.min(initial=0)) for x in ids), max(int(x.max(initial=0)) for x in ids)
    if low < 0 or high > 4 * sum(map(len, ids)) + 1_000_000:
        known = np.unique(np.concatenate(ids))
        return len(known), *(np.searchsorted(known, x) for x in ids)
    return high + 1, *(x.astype(np.int64) for x in ids)


def common(x: np.ndarray, y: np.ndarray, own: np.ndarray, to: np.ndarray, width: int) -> int:
    """Over the pairs (x, y), how many ``to`` stand beside both as ``own``; the shorter list is walked, the longer one is marked."""
    if not len(x) or not len(to):
        return 0
    low = (1 << 32) - 1
    lens = np.bincount(own, minlength=int(max(x.max(), y.max())) + 1)
    start = np.cumsum(lens) - lens
    to = own << 32 | to
    to.sort()
    to &= low
    swap = lens[x] < lens[y]
    mark, walk = np.where(swap, y, x), np.where(swap, x, y)
    pair = (mark << 32 | walk)[lens[walk] > 0]
    pair.sort()
    mark, walk = pair >> 32, pair & low
    sums, rank = np.cumsum(lens[walk]), np.cumsum(np.diff(mark, prepend=-1) != 0)
    held = max(1, min(MARKS // width, int(rank.max(initial=1))))
    marks, n, a, done = np.zeros(held * width, bool), 0, 0, 0

    def entries(rows: np.ndarray, shift: np.ndarray) -> np.ndarray:
        size = lens[rows]
        at = np.repeat(start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return to[at] + np.repeat(shift * width, size)

    while a < len(walk):
        b = max(a + 1, min(int(np.searchsorted(sums, done + ENDS, "right")), int(np.searchsorted(rank, rank[a] + held))))
        shift = rank[a:b] - rank[a]
        first = np.flatnonzero(np.diff(shift, prepend=-1))
        marked = entries(mark[a:b][first], shift[first])
        marks[marked] = True
        n += int(np.count_nonzero(marks[entries(walk[a:b], shift)]))
        marks[marked] = False
        a, done = b, int(sums[b - 1])
    return n
