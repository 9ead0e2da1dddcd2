"""Relabelling and the label-partitioned adjacency index, with its positional views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hubs, label_offsets
from ..graph import LabeledGraph, running
from ..sources.text import write_graph


def partition_ids(g: LabeledGraph) -> DataFrame:
    """id, label, new_id: ids dealt anew so that each label owns a contiguous range, by id within it."""
    start = label_offsets(g).select(F.col("label").cast("int").alias("label"), "start")  # a row a label
    ranked = running(g.vertices.select("id", "label"), F.lit(1), "id", ["label"], "rank")
    return ranked.join(start, "label").select("id", F.col("label").cast("long").alias("label"), (F.col("start") + F.col("rank")).alias("new_id"))


def relabelled(g: LabeledGraph, ids: DataFrame) -> LabeledGraph:
    """The graph under new ids (columns id, new_id)."""
    m = ids.select("id", "new_id")
    v = g.vertices.join(m, "id").select(F.col("new_id").alias("id"), "label", "raw_label")
    a = g.arcs.join(m.toDF("u", "nu"), "u").join(m.toDF("v", "nv"), "v").select(F.col("nu").alias("u"), "lu", F.col("nv").alias("v"), "lv")
    return LabeledGraph(v, a, g.labels)


def neighborhood(g: LabeledGraph) -> DataFrame:
    """id, mask, address: the labels among the neighbours, and where the vertex's slots start."""
    own = g.degrees().groupBy(F.col("u").alias("id")).agg(F.count("*").alias("slots"))
    rows = g.masks().select("id", "mask").join(own, "id", "left")
    return running(rows, F.coalesce("slots", F.lit(0)), "id", name="address").select("id", "mask", "address")


def slots(g: LabeledGraph) -> DataFrame:
    """id, neighbor_label, ordinal, begin, stop: each (vertex, label) slot, its place among the label's
    vertices, and its run in the label's concatenated neighbours."""
    rows = g.degrees().select("u", "lv", "deg")
    rows = running(rows, F.lit(1), "u", ["lv"], "ordinal")
    rows = running(rows, F.col("deg"), "u", ["lv"], "begin")
    return rows.select(F.col("u").alias("id"), F.col("lv").cast("long").alias("neighbor_label"), "ordinal", "begin", (F.col("begin") + F.col("deg")).alias("stop"))


def slot_lookup(g: LabeledGraph) -> DataFrame:
    """id, neighbor_label, slot: the vertex's address plus the label's place among its neighbours' labels, however many there are."""
    below = F.row_number().over(Window.partitionBy("id").orderBy("neighbor_label")) - 1
    own = g.degrees().select(F.col("u").alias("id"), F.col("lv").cast("long").alias("neighbor_label"))
    return own.withColumn("below", below).join(neighborhood(g), "id").select("id", "neighbor_label", (F.col("address") + F.col("below")).cast("long").alias("slot"))


def adjacency_rows(g: LabeledGraph) -> DataFrame:
    """id, neighbor_label, position, neighbor: the concatenated lists, a row an entry; positions are running counts, so no list is ever built."""
    rows = running(g.arcs.select("u", "lv", "v"), F.lit(1), "v", ["u", "lv"], "position")
    return rows.select(F.col("u").alias("id"), F.col("lv").cast("long").alias("neighbor_label"), "position", F.col("v").alias("neighbor"))


def without_hubs(g: LabeledGraph, least: int) -> LabeledGraph:
    """All vertices; only edges between vertices whose per-label degrees stay under ``least``."""
    far = hubs(g, least).select("id")
    arcs = g.arcs.join(far.toDF("u"), "u", "left_anti").join(far.toDF("v"), "v", "left_anti")
    return LabeledGraph(g.vertices, arcs.select("u", "lu", "v", "lv"), g.labels)


def without_vertex(g: LabeledGraph, vertex: int) -> LabeledGraph:
    """All vertices; the edges that do not touch ``vertex``."""
    return LabeledGraph(g.vertices, g.arcs.filter((F.col("u") != vertex) & (F.col("v") != vertex)), g.labels)


def edges(g: LabeledGraph) -> DataFrame:
    """src, dst: each edge once, src < dst."""
    return g.arcs.filter("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"))


def save(g: LabeledGraph, path: str) -> None:
    """Write the index as Parquet: links by neighbour label, sorted by (label, vertex), so that a step of a
    match reads one folder's needed columns and row groups; and the statistics that matches are planned by.

    Files are ranges of (neighbour label, label, vertex): one label or one hub is cut over many.
    """
    g.masks().join(g.vertices.select("id", "raw_label"), "id").write.parquet(f"{path}/vertices")
    g.labels.write.parquet(f"{path}/labels")
    order = ["lv", "lu", "u", "v"]
    g.links().repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("lv").parquet(f"{path}/links")
    for name, df in (("pairs", g.pairs()), ("signatures", g.signatures())):
        df.write.parquet(f"{path}/{name}")


def load(spark, path: str) -> LabeledGraph:
    v = spark.read.parquet(f"{path}/vertices")
    # With the schema given, a graph without edges, whose folder has no files, reads as empty.
    links = spark.read.schema("u long, lu int, v long, mask long, lv int").parquet(f"{path}/links").select("u", "lu", "v", "lv", "mask")
    g = LabeledGraph(v.select("id", "label", "raw_label"), links.drop("mask"), spark.read.parquet(f"{path}/labels"))
    g._memo |= {"links": links, "masks": v.select("id", "label", "mask", "degree")} | {name: spark.read.parquet(f"{path}/{name}") for name in ("pairs", "signatures")}
    return g


def export_without_hubs(g: LabeledGraph, least: int, path: str) -> None:
    """The graph without the hubs' edges as text lines, and beside it the hubs left out, ``<id> <largest per-label degree>``."""
    write_graph(without_hubs(g, least), f"{path}/graph")
    hubs(g, least).orderBy("id").select(F.concat_ws(" ", "id", "partition_max_degree").alias("value")).write.text(f"{path}/hubs")
