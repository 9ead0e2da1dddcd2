"""Orders of vertices: label-contiguous permutations of ids, and what they are chosen by."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import label_offsets, partition_max_degree
from ..graph import LabeledGraph, running

#: Vertices that the greedy order sees at once; a label of more is cut into runs of about as many.
RUN = 4096
#: Neighbours of one label on one key of the sibling join; a vertex with more is dealt to several keys.
HEAVY = 2048


def _dealt(g: LabeledGraph, keys: DataFrame, *order: str) -> DataFrame:
    """id, label, new_id by label and the columns ``order`` (longs) of ``keys`` (id, label, order...), then id.

    Ranks come from counts of the distinct keys before a key (small rows), and of the ids
    within a key; so neither a label nor a hub-free mass of equal degrees is one task's work.
    """
    groups = keys.groupBy("label", *order).agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    inside = running(keys, F.lit(1), "id", ["label", *order], "inside")
    start = label_offsets(g).select(F.col("label").cast("int").alias("label"), "start")
    out = inside.join(groups, ["label", *order]).join(start, "label")
    return out.select("id", F.col("label").cast("long").alias("label"), (F.col("start") + F.col("before") + F.col("inside")).alias("new_id"))


def by_degree(g: LabeledGraph) -> DataFrame:
    """Each label's vertices by ascending degree."""
    return _dealt(g, g.masks().select("id", "label", "degree"), "degree")


def hubs_last(g: LabeledGraph, most: int) -> DataFrame:
    """Each label's vertices by id, those with a per-label degree over ``most`` after the others."""
    top = partition_max_degree(g)
    keys = g.vertices.select("id", "label").join(top, "id").select("id", "label", (F.col("partition_max_degree") > most).cast("long").alias("hub"))
    return _dealt(g, keys, "hub")


def common_neighbors(g: LabeledGraph) -> DataFrame:
    """a, b, neighbor_label, common: shared neighbours of two vertices of one label, a < b.

    A neighbour shared by d vertices of a label makes d^2 / 2 pairs, which are the result; where d is large
    the left side of its pairs is dealt to several keys by a hash, so that they are many tasks' work.
    """
    size = g.degrees().select(F.col("u").alias("v"), F.col("lu").alias("lv"), F.col("lv").alias("l"), F.expr(f"cast((deg - 1) div {HEAVY} + 1 as int)").alias("keys"))
    own = g.arcs.select(F.col("u").alias("a"), F.col("lu").alias("l"), "v", "lv").join(size, ["v", "lv", "l"])
    left = own.withColumn("k", F.pmod(F.xxhash64("a"), F.col("keys")).cast("int")).select("a", "l", "v", "lv", "k")
    right = own.select(F.col("a").alias("b"), "l", "v", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("k"))
    both = left.join(right, ["v", "l", "k"]).filter("a < b")
    return both.groupBy("a", "b", F.col("lv").cast("long").alias("neighbor_label")).agg(F.count("*").alias("common"))


def top_common(g: LabeledGraph, k: int) -> DataFrame:
    """a, rank, b, common: for each vertex the k siblings it shares most neighbours with; ties to the lower id."""
    pair = common_neighbors(g).groupBy("a", "b").agg(F.sum("common").alias("common"))
    both = pair.union(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    w = Window.partitionBy("a").orderBy(F.desc("common"), "b")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("a", "rank", "b", "common")


def locality(g: LabeledGraph, most: int = 10_000, window: int = 8, run: int = RUN) -> DataFrame:
    """id, label, new_id: label-contiguous, hubs last, neighbours of like vertices close together.

    Within a run of a label's vertices the next one is that of best locality (``locality_order``) with the
    last ``window`` - 1 placed. A run is a fixed number of vertices next to each other by (hub, least
    neighbour, id), so the order of a label of any size is many tasks' work. Neighbours that are hubs (a
    per-label degree over ``most``) do not count, and hubs keep the order of the run.
    """
    top = partition_max_degree(g).select("id", (F.col("partition_max_degree") > most).cast("long").alias("hub"))
    first = g.arcs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near"))
    keys = g.vertices.select("id", "label").join(first, "id", "left").join(top, "id")
    keys = keys.select("id", "label", "hub", F.coalesce("near", F.lit(-1)).alias("near"))
    base = _dealt(g, keys, "hub", "near").join(keys.select("id", "hub"), "id")
    runs = base.withColumn("run", F.expr(f"new_id div {run}"))
    low = top.filter("hub = 0").select("id")
    arcs = g.arcs.join(low.toDF("u"), "u", "left_semi").join(low.toDF("v"), "v", "left_semi").select(F.col("u").alias("id"), "v", "lv")
    sizes = g.labels.agg(F.count("*").alias("labels"))  # one row
    rows = runs.join(arcs, "id", "left").crossJoin(F.broadcast(sizes)).select(
        "id", "label", "hub", "run", "new_id", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lv", F.lit(-1)).alias("lv"), "labels")  # no nulls: ids stay longs

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[["id", "label", "new_id"]].drop_duplicates("id").sort_values("new_id")
        known = pdf[pdf["lv"] >= 0]
        lists: list[dict[int, set[int]]] = [{} for _ in range(len(own))]
        place = dict(zip(own["id"], range(len(own))))
        for i, v, lv in zip(known["id"], known["v"], known["lv"]):
            lists[place[i]].setdefault(int(lv), set()).add(int(v))
        order = locality_order(lists, window, int(pdf["labels"].iloc[0]))
        return pd.DataFrame({"id": own["id"].to_numpy()[order], "label": own["label"].to_numpy()[order], "new_id": own["new_id"].to_numpy()})

    return rows.groupBy("label", "hub", "run").applyInPandas(ordered, "id long, label long, new_id long")


def locality_order(lists: list[dict[int, set[int]]], window: int, labels: int) -> list[int]:
    """Greedy order of vertices, given by their neighbours of each label, from the first on.

    The score of a vertex: over the last ``window`` - 1 placed, the latest first, and each label of which it shares
    neighbours with one, their number over the neighbours read so far (its own of the label and those of the
    placed vertices counted up to there) times the number of labels. Ties, and vertices that share nothing, go by place.
    """
    at: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for part in own.values():
            for v in part:
                at.setdefault(v, []).append(i)
    left, order = dict.fromkeys(range(len(lists))), []
    shared: list[dict[int, dict[int, int]]] = []  # of each recent vertex, the latest first: sibling -> label -> common neighbours
    while left:
        score: dict[int, float] = {}
        read: dict[tuple[int, int], int] = {}
        for placed, common in zip(reversed(order), shared):
            for j, by_label in common.items():
                if j in left:
                    for label, n in by_label.items():
                        read[j, label] = read.get((j, label), len(lists[j][label])) + len(lists[placed][label])
                        score[j] = score.get(j, 0.0) + n / (read[j, label] * labels)
        best = min(score, key=lambda j: (-score[j], j)) if score else next(iter(left))
        del left[best]
        order.append(best)
        found: dict[int, dict[int, int]] = {}
        for label, part in lists[best].items():
            for v in part:
                for j in at[v]:
                    if j in left:
                        own = found.setdefault(j, {})
                        own[label] = own.get(label, 0) + 1
        shared = [found, *shared][: window - 1]
    return order
