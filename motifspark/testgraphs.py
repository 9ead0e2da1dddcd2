"""Graphs made of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import LabeledGraph, build
from .operators.direct import DirectGraph

_kept: dict[tuple[str, str, str], LabeledGraph] = {}


def _kept_graph(spark: SparkSession, sf_dir: str, kind: str, make) -> LabeledGraph:
    """One persisted graph a session and input, as an index that is built once."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0] or k[2] == kind]:
            g = _kept.pop(old)
            if old[0] == key[0]:
                g.unpersist()
        _kept[key] = make(spark, sf_dir).persist()
    return _kept[key]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
TIES = [("nation", "n_nationkey", 1, "n_regionkey", 0), ("customer", "c_custkey", 2, "c_nationkey", 1), ("supplier", "s_suppkey", 3, "s_nationkey", 1), ("orders", "o_orderkey", 5, "o_custkey", 2),
        ("lineitem", "l_orderkey", 5, "l_partkey", 4), ("lineitem", "l_orderkey", 5, "l_suppkey", 3), ("lineitem", "l_partkey", 4, "l_suppkey", 3)]


def _key(c: str, label: int) -> Column:
    return F.col(c).cast("long") * 8 + label


def entity_tables(spark: SparkSession, d: str) -> DirectGraph:
    """The entities and their foreign keys as they lie in the tables, without an index."""
    v = {label: _t(spark, d, name).select(_key(c, label).alias("id")) for label, (name, c) in enumerate(KINDS)}
    return DirectGraph(v, {(la, lb): _t(spark, d, name).select(_key(a, la).alias("u"), _key(b, lb).alias("v")) for name, a, la, b, lb in TIES})


def _entities(spark: SparkSession, d: str) -> LabeledGraph:
    t = entity_tables(spark, d)
    v = reduce(DataFrame.union, (own.select("id", F.lit(label).alias("raw_label")) for label, own in t.vertices.items()))
    return build(v, reduce(DataFrame.union, (own.toDF("src", "dst") for own in t.edges.values())))


def _purchases(spark: SparkSession, d: str, labels: int = 20) -> LabeledGraph:
    v = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % labels).alias("raw_label"))
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    e = li.toDF("o", "src").join(li.toDF("o", "dst"), "o").filter("src < dst").select("src", "dst")
    return build(v, e)


def shared_orders(spark: SparkSession, d: str) -> DataFrame:
    """u, v: parts of one order, u < v, a row for each order that they share."""
    known = _t(spark, d, "part").filter("p_size is not null").select(F.col("p_partkey").cast("long").alias("u")).distinct()
    own = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("long").alias("u")).join(known, "u")
    own = own.repartition("o").distinct()
    return own.join(own.select(F.col("u").alias("v"), "o"), "o").filter("u < v").select("u", "v")


def shared_order_arcs(spark: SparkSession, d: str, labels: int = 20) -> DataFrame:
    """u, lu, v: parts of one order in both directions, with the label of u, a row for each order that they share."""
    known = _t(spark, d, "part").filter("p_size is not null").select(F.col("p_partkey").cast("long").alias("u"), (F.col("p_size") % labels).cast("int").alias("lu")).dropDuplicates(["u"])
    own = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("long").alias("u")).join(known, "u")
    own = own.repartition("o").distinct()
    return own.join(own.select(F.col("u").alias("v"), "o"), "o").filter("u <> v").select("u", "lu", "v")


def entities(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    """Six kinds of entities and their foreign keys."""
    return _kept_graph(spark, sf_dir, "entities", _entities)


def purchases(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    """Parts that share an order; 20 labels."""
    return _kept_graph(spark, sf_dir, "purchases", _purchases)


def unlabelled(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    """The same with one label."""
    return _kept_graph(spark, sf_dir, "unlabelled", lambda s, d: _purchases(s, d, 1))
