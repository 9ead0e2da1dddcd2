"""Text formats: data graphs as lines, and three encodings of patterns.

Fixed values, the line formats: a data graph has ``t <vertices> <edges>``, ``v <id> <label>``
and ``e <from> <to> <edge label>``; a native pattern is the same; a degree pattern has
``t 1 <vertices> <twice the edges>`` and ``<id> <label> <degree> <neighbours...>``; an
annotated pattern has ``t <vertices> <edges>``, ``v <id> <label> <degree>``, ``e <from> <to>``
and ``t # -1`` at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import LabeledGraph, build
from ..plans.planner import Pattern


def read_graph(spark: SparkSession, path: str) -> LabeledGraph:
    """A data graph from text lines; edge labels are read over, unknown lines ignored."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(f.alias("f"))
    part = lambda kind, n: lines.filter((F.col("f")[0] == kind) & (F.size("f") >= n))
    v = part("v", 3).select(F.col("f")[1].cast("long").alias("id"), F.col("f")[2].cast("int").alias("raw_label"))
    e = part("e", 3).select(F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"))
    return build(v, e)


def graph_lines(g: LabeledGraph) -> DataFrame:
    """kind (0 head, 1 vertex, 2 edge), a, b, value: the graph as text lines, each edge once."""
    v = g.vertices.select(F.lit(1).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "id", "raw_label").alias("value"))
    e = g.arcs.filter("u < v").select(F.lit(2).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.concat_ws(" ", F.lit("e"), "u", "v", F.lit("0")).alias("value"))
    n = v.agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("m")))
    head = n.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("t"), "n", "m").alias("value"))
    return head.union(v).union(e)


def write_graph(g: LabeledGraph, path: str) -> None:
    """Text files whose concatenation by name is one graph file: a range sort, no single task."""
    graph_lines(g).orderBy("kind", "a", "b").select("value").write.text(path)


def write_labels(g: LabeledGraph, path: str) -> None:
    """``<dense> <raw>`` lines."""
    g.labels.orderBy("label").select(F.concat_ws(" ", "label", "raw_label").alias("value")).write.text(path)


def read_pattern(text: str) -> Pattern:
    """A pattern in any of the three encodings."""
    rows = [x.split() for x in text.splitlines() if x.split()]
    if any(r[0] in ("v", "e") for r in rows):
        labels = {int(r[1]): int(r[2]) for r in rows if r[0] == "v"}
        edges = [(int(r[1]), int(r[2])) for r in rows if r[0] == "e"]
    else:
        body = [list(map(int, r)) for r in rows if r[0] != "t"]
        labels = {r[0]: r[1] for r in body}
        edges = [(r[0], w) for r in body for w in r[3:]]
    if sorted(labels) != list(range(len(labels))):
        raise ValueError("pattern vertices must be numbered from 0")
    return Pattern.of([labels[i] for i in range(len(labels))], edges)


def write_pattern(p: Pattern, encoding: str = "native") -> str:
    edges = sorted(p.edges)
    if encoding == "degree":
        rows = [f"t 1 {p.n} {2 * len(edges)}"] + [" ".join(map(str, [v, p.labels[v], p.degree(v), *p.neighbors(v)])) for v in range(p.n)]
    elif encoding == "annotated":
        rows = [f"t {p.n} {len(edges)}", *(f"v {v} {p.labels[v]} {p.degree(v)}" for v in range(p.n)), *(f"e {a} {b}" for a, b in edges), "t # -1"]
    elif encoding == "native":
        rows = [f"t {p.n} {len(edges)}", *(f"v {v} {p.labels[v]}" for v in range(p.n)), *(f"e {a} {b} 0" for a, b in edges)]
    else:
        raise ValueError(f"unknown encoding {encoding}")
    return "\n".join(rows) + "\n"
