"""The data model: a vertex-labelled undirected simple graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: A global running sum is cut into this many slices, or more, so that one holds some ``SLICE_ROWS`` rows; a slice is one task's work.
SLICES, SLICE_ROWS = 512, 1_000_000
#: Labels, or pairs of labels, that the driver keeps of a graph; beyond, each pattern asks the tables.
KNOWN = 10_000
#: Neighbours in one list; a vertex with more of a label has several lists.
LIST = 65_536


@dataclass
class Catalog:
    """Statistics that matches are planned by: dense labels by raw label, rows of ``pairs`` and of ``signatures``."""

    labels: dict[int, int] | None
    pairs: list[Row] | None
    signatures: list[Row] | None


@dataclass
class LabeledGraph:
    """vertices(id, label, raw_label), arcs(u, lu, v, lv) in both directions, labels(raw_label, label).

    Labels are dense: a raw label's number is its place by first appearance (least id).
    Loops and repeated edges are dropped; edges to unknown vertices are too.
    """

    vertices: DataFrame
    arcs: DataFrame
    labels: DataFrame
    _memo: dict = field(default_factory=dict, repr=False)

    def _once(self, name: str, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    def degrees(self) -> DataFrame:
        """u, lu, lv, deg: how many neighbours of each label, for each vertex and label it is next to."""
        return self._once("degrees", lambda: self.arcs.groupBy("u", "lu", "lv").agg(F.count("*").alias("deg")))

    def adjacency(self) -> DataFrame:
        """u, lu, lv, chunk, nbrs (ascending): lists of ``LIST`` neighbours or so; a hub has several, parted by a hash."""
        def make() -> DataFrame:
            large = self.degrees().filter(F.col("deg") > LIST).select("u", "lv", F.expr(f"cast(deg div {LIST} + 1 as int)").alias("chunks"))
            rows = self.arcs.join(large, ["u", "lv"], "left")
            chunk = F.coalesce(F.pmod(F.xxhash64("v"), F.col("chunks")), F.lit(0)).cast("int")
            return rows.groupBy("u", "lu", "lv", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("v")).alias("nbrs"))

        return self._once("adjacency", make)

    def masks(self) -> DataFrame:
        """id, label, mask (bits of the neighbours' labels), degree, of every vertex; isolated ones have 0."""
        def make() -> DataFrame:
            bits = self.degrees().groupBy(F.col("u").alias("id")).agg(F.bit_or(bit(F.col("lv"))).alias("mask"), F.sum("deg").alias("degree"))
            rows = self.vertices.join(bits, "id", "left")
            return rows.select("id", "label", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("mask", "degree")))

        return self._once("masks", make)

    def links(self) -> DataFrame:
        """u, lu, v, lv, mask: the arcs with the mask of v, so that a match tests a neighbour where it reads it."""
        return self._once("links", lambda: self.arcs.join(self.masks().select(F.col("id").alias("v"), "mask"), "v").select("u", "lu", "v", "lv", "mask"))

    def pairs(self) -> DataFrame:
        """lu, lv, n, ends, most: for each label and neighbour label the vertices that have such neighbours, how many those are in all, and at one vertex at most."""
        return self._once("pairs", lambda: self.degrees().groupBy("lu", "lv").agg(F.count("*").alias("n"), F.sum("deg").alias("ends"), F.max("deg").alias("most")))

    def signatures(self) -> DataFrame:
        """label, mask, n: how many vertices of a label have a mask."""
        return self._once("signatures", lambda: self.masks().groupBy("label", "mask").agg(F.count("*").alias("n")))

    def catalog(self) -> "Catalog":
        """What the driver keeps of the index; a table of over ``KNOWN`` rows is None there, and each pattern asks the table."""
        def rows(df: DataFrame) -> list | None:
            out = df.limit(KNOWN + 1).collect()
            return out if len(out) <= KNOWN else None

        def make() -> Catalog:
            labels, pairs, signatures = rows(self.labels), rows(self.pairs()), rows(self.signatures())
            return Catalog(None if labels is None else {r["raw_label"]: r["label"] for r in labels}, pairs, signatures)

        return self._once("catalog", make)

    def persist(self) -> "LabeledGraph":
        """Keep the tables in memory or on disk, as an index is: links lie by labels, so that a step reads few batches."""
        for name in ("vertices", "labels"):
            setattr(self, name, getattr(self, name).persist())
        self._memo.clear()
        self.arcs = self.arcs.persist()
        self._memo["degrees"] = self.degrees().persist()
        self._memo["masks"] = self.masks().persist()
        self._memo["links"] = self.links().repartition("u").sortWithinPartitions("lu", "lv", "u").persist()
        for name in ("pairs", "signatures", "adjacency"):
            self._memo[name] = getattr(self, name)().persist()
        return self

    def unpersist(self) -> None:
        for df in (self.vertices, self.arcs, self.labels, *self._memo.values()):
            if isinstance(df, DataFrame):
                df.unpersist()


def bit(label: Column) -> Column:
    """1 << label as a long; labels above 63 share the bits, which keeps mask tests sound as filters."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(label, F.lit(64)).cast("int"))


def build(vertices: DataFrame, edges: DataFrame) -> LabeledGraph:
    """A graph from vertices(id, raw_label) and edges(src, dst) in any direction, repeated or not."""
    v = vertices.select(F.col("id").cast("long").alias("id"), F.col("raw_label").cast("int").alias("raw_label")).dropDuplicates(["id"])
    first = v.groupBy("raw_label").agg(F.min("id").alias("first"))
    labels = first.select("raw_label", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("label"))
    v = v.join(labels, "raw_label").select("id", "label", "raw_label")
    e = edges.select(F.col("src").cast("long").alias("s"), F.col("dst").cast("long").alias("d")).filter("s <> d")
    e = e.select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct()
    end = v.select(F.col("id"), F.col("label"))
    known = e.join(end.toDF("s", "ls"), "s").join(end.toDF("d", "ld"), "d")
    both = F.array(*(F.struct(F.col(a).alias("u"), F.col(la).alias("lu"), F.col(b).alias("v"), F.col(lb).alias("lv")) for a, la, b, lb in (("s", "ls", "d", "ld"), ("d", "ld", "s", "ls"))))
    return LabeledGraph(v, known.select(F.inline(both)), labels)


def running(df: DataFrame, value: Column, order: str, by: list[str] | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before it by ``order`` (unique within ``by``).

    Two levels: the order is cut into even ranges, ``SLICES`` or as many as the rows ask for; totals of
    ranges are summed first (few rows), then each range on its own. No task sees more than a
    range of a group.
    """
    by = by or []
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.greatest(F.lit(float(SLICES)), F.count("*") / float(SLICE_ROWS)).alias("_cuts"))  # one row
    df = df.crossJoin(F.broadcast(ends))
    width = (F.col("_hi").cast("double") - F.col("_lo") + 1) / F.col("_cuts")
    df = df.withColumn("_slice", F.floor((F.col(order).cast("double") - F.col("_lo")) / width).cast("long")).withColumn("_value", value.cast("long")).drop("_lo", "_hi", "_cuts")
    zero = F.lit(0).cast("long")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_slice").agg(F.sum("_value").alias("_t"))
    totals = totals.select(*by, "_slice", F.coalesce(F.sum("_t").over(past(Window.partitionBy(*by).orderBy("_slice"))), zero).alias("_offset"))
    inside = F.coalesce(F.sum("_value").over(past(Window.partitionBy(*by, "_slice").orderBy(order))), zero)
    out = df.withColumn("_inside", inside).join(totals, [*by, "_slice"])
    return out.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_slice", "_value", "_inside", "_offset")
