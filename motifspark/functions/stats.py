"""Graph statistics: counts, degrees, label histograms, two-hop sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import LabeledGraph


def vertex_degree(g: LabeledGraph) -> DataFrame:
    """id, degree; isolated vertices have 0."""
    return g.masks().select("id", "degree")


def label_degree(g: LabeledGraph) -> DataFrame:
    """id, neighbor_label, degree: neighbours of each label."""
    return g.degrees().select(F.col("u").alias("id"), F.col("lv").cast("long").alias("neighbor_label"), F.col("deg").alias("degree"))


def partition_max_degree(g: LabeledGraph) -> DataFrame:
    """id, partition_max_degree: the largest of a vertex's per-label degrees."""
    top = label_degree(g).groupBy("id").agg(F.max("degree").alias("m"))
    return g.vertices.join(top, "id", "left").select("id", F.coalesce("m", F.lit(0)).cast("long").alias("partition_max_degree"))


def graph_summary(g: LabeledGraph) -> DataFrame:
    """One row: vertices, edges, labels, max and average (integer) degree, largest per-label degree."""
    d = g.masks().agg(F.count("*").alias("vertices"), F.countDistinct("label").alias("labels"), F.expr("sum(degree) div 2").alias("edges"),
                      F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.expr("coalesce(sum(degree) div count(*), 0)").alias("avg_degree"))
    m = partition_max_degree(g).agg(F.coalesce(F.max("partition_max_degree"), F.lit(0)).alias("partition_max_degree"))
    return d.crossJoin(m).select(*(F.col(c).cast("long").alias(c) for c in ("vertices", "edges", "labels", "max_degree", "avg_degree", "partition_max_degree")))


def label_histogram(g: LabeledGraph) -> DataFrame:
    return g.vertices.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("vertices"))


def label_offsets(g: LabeledGraph) -> DataFrame:
    """label, start, stop: where each label's run of ids starts when ids are dealt label by label."""
    w = Window.orderBy("label")  # a row a label
    stop = F.sum("vertices").over(w)
    return label_histogram(g).select("label", (stop - F.col("vertices")).alias("start"), stop.alias("stop"))


def two_hop_label_degree(g: LabeledGraph) -> DataFrame:
    """id, neighbor_label, two_hop: the sum over neighbours of their degree to the label."""
    d = label_degree(g).withColumnRenamed("id", "v")
    return g.arcs.select("u", "v").join(d, "v").groupBy(F.col("u").alias("id"), "neighbor_label").agg(F.sum("degree").alias("two_hop"))


def hubs(g: LabeledGraph, least: int) -> DataFrame:
    """id, partition_max_degree of the vertices with a per-label degree of ``least`` or more."""
    return partition_max_degree(g).filter(F.col("partition_max_degree") >= least)


def hub_count(g: LabeledGraph, least: int) -> DataFrame:
    """hubs: how many vertices have a per-label degree of ``least`` or more."""
    return hubs(g, least).agg(F.count("*").alias("hubs"))


def label_pair_cardinality(g: LabeledGraph) -> DataFrame:
    """label, neighbor_label, vertices: how many vertices of a label have a neighbour of another."""
    return g.pairs().select(F.col("lu").cast("long").alias("label"), F.col("lv").cast("long").alias("neighbor_label"), F.col("n").alias("vertices"))


def adjacency_lists(g: LabeledGraph) -> DataFrame:
    """id, neighbors: ascending, as text joined by spaces; a dump for the eye, a row a vertex, so a hub's row holds its whole list."""
    return g.arcs.groupBy(F.col("u").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("v")), " ").alias("neighbors"))
