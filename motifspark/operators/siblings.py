"""The siblings that share most neighbours, by parts of the vertices.

A vertex's neighbours of one label are a list. It goes to each part (a range of ids) that has one of
them, once, and pairs are made there, for some vertices at a time; no pair is ever a row. A list travels once or
twice where ids lie close to their siblings', as often as it has members, or there are parts, at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Arcs of a part or so, and parts at most.
PART, PARTS = 1_000_000, 1000
#: Pairs that are held at once, but that those of one vertex stay together.
PAIRS = 2_000_000


def top_common(arcs: DataFrame, k: int) -> DataFrame:
    """a, rank, b, common: for each vertex the ``k`` of its label it shares most neighbours with; ties to the lower id.

    ``arcs`` (u, lu, v), in both directions, may repeat.
    """
    spark = arcs.sparkSession
    path = scratch(spark, "siblings")
    lists = arcs.repartition("v").groupBy("v", "lu").agg(F.array_sort(F.array_distinct(F.collect_list("u"))).alias("own")).filter("size(own) > 1").select("own")
    lists.write.parquet(path)
    lists = spark.read.schema(lists.schema).parquet(path)
    total = lists.agg(F.sum(F.size("own"))).first()[0] or 0
    parts = min(PARTS, total // PART + 1)
    firsts = lists.select(F.element_at("own", 1).alias("u")).union(lists.select(F.element_at("own", -1)))
    cuts = sorted({int(x) for x in firsts.approxQuantile("u", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []

    def number(u):
        return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= u)) if cuts else F.lit(0)

    # Lists are sorted: from the part of the first to that of the last, those that have a member.
    ends = lists.select("own", number(F.element_at("own", 1)).alias("lo"), number(F.element_at("own", -1)).alias("hi"))
    inner = F.array_distinct(F.transform("own", number)) if cuts else F.array(F.lit(0))
    sent = ends.select("own", F.explode(F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(inner)).alias("part"))
    bounds = [-(1 << 63), *cuts, (1 << 63) - 1]

    def ranked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(key[0])
        return best(list(pdf["own"]), bounds[p], bounds[p + 1], p + 2 == len(bounds), k)

    return sent.groupBy("part").applyInPandas(ranked, "a long, rank long, b long, common long")


def best(lists: list[np.ndarray], low: int, high: int, last: bool, k: int) -> pd.DataFrame:
    """The ``k`` best siblings of the vertices from ``low`` on and below ``high`` (or ``last``: up to it)."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    ids, flat = np.unique(np.concatenate([np.zeros(0, np.int64), *lists]), return_inverse=True)
    start, home = np.cumsum(lens) - lens, np.repeat(np.arange(len(lists)), lens)
    mine = (ids >= low) & ((ids <= high) if last else (ids < high))
    at = np.flatnonzero(mine[flat])
    at = at[np.argsort(flat[at], kind="stable")]  # memberships by vertex
    whose, home = flat[at], home[at]
    sums = np.cumsum(lens[home])
    edges = np.append(np.flatnonzero(np.diff(whose)) + 1, len(whose))  # where a vertex's memberships end
    out, i, done = [], 0, 0
    while i < len(whose):
        j = int(edges[min(len(edges) - 1, max(np.searchsorted(edges, i, "right"), np.searchsorted(sums[edges - 1], done + PAIRS, "right") - 1))])
        n = lens[home[i:j]]
        a = np.repeat(whose[i:j], n)
        b = flat[np.repeat(start[home[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair, common = np.unique((a * len(ids) + b)[a != b], return_counts=True)
        a, b = pair // len(ids), pair % len(ids)
        order = np.lexsort((b, -common, a))
        a, b, common = a[order], b[order], common[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) + 1
        good = rank <= k
        out.append((ids[a[good]], rank[good], ids[b[good]], common[good]))
        i, done = j, int(sums[j - 1])
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(("a", "rank", "b", "common"), cols)))
