"""Which data vertices can stand for which pattern vertices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..graph import LabeledGraph
from ..plans.planner import Pattern


def dense_labels(g: LabeledGraph, pattern: Pattern) -> list[int] | None:
    """The pattern's labels in the graph's numbering; None if the graph lacks one."""
    known = g.catalog().labels
    if known is None:
        rows = g.labels.filter(F.col("raw_label").isin(*set(pattern.labels))).collect()  # a row a pattern vertex at most
        known = {r["raw_label"]: r["label"] for r in rows}
    return [known[x] for x in pattern.labels] if all(x in known for x in pattern.labels) else None


def wanted_mask(pattern: Pattern, dense: list[int], v: int) -> int:
    """The neighbour-label bits a candidate for v must have, as a signed long."""
    m = reduce(lambda m, w: m | 1 << (dense[w] % 64), pattern.neighbors(v), 0)
    return m - (1 << 64) if m >> 63 else m


def has_neighbors(pattern: Pattern, dense: list[int], v: int) -> Column:
    """On column mask: all labels next to pattern vertex v are there."""
    m = F.lit(wanted_mask(pattern, dense, v)).cast("long")
    return F.col("mask").bitwiseAND(m) == m


def fits(pattern: Pattern, dense: list[int], v: int) -> Column:
    """On columns label and mask: the label is right and all neighbour labels are there."""
    return (F.col("label") == dense[v]) & has_neighbors(pattern, dense, v)


def candidates(g: LabeledGraph, pattern: Pattern, dense: list[int], v: int) -> DataFrame:
    """id of each candidate of pattern vertex v."""
    return g.masks().filter(fits(pattern, dense, v)).select("id")


def candidate_counts(g: LabeledGraph, pattern: Pattern, dense: list[int]) -> list[int]:
    """Candidates of every pattern vertex: sums over the masks' counts, on the driver where it keeps them, else by one aggregate."""
    known = g.catalog().signatures
    if known is not None:
        masks = [wanted_mask(pattern, dense, v) for v in range(pattern.n)]
        return [sum(r["n"] for r in known if r["label"] == dense[v] and r["mask"] & masks[v] == masks[v]) for v in range(pattern.n)]
    rows = g.signatures().filter(F.col("label").isin(*set(dense)))
    row = rows.agg(*(F.coalesce(F.sum(F.when(fits(pattern, dense, v), F.col("n"))), F.lit(0)).alias(f"c{v}") for v in range(pattern.n))).first()
    return [row[f"c{v}"] for v in range(pattern.n)]


def label_pairs(g: LabeledGraph, pattern: Pattern, dense: list[int]) -> dict[tuple[int, int], Row]:
    """For each (label, neighbour label) of the pattern's edges the row of ``pairs``."""
    pairs = {(dense[v], dense[w]) for v in range(pattern.n) for w in pattern.neighbors(v)}
    rows = g.catalog().pairs
    if rows is None and pairs:
        want = reduce(lambda a, b: a | b, ((F.col("lu") == a) & (F.col("lv") == b) for a, b in pairs))
        rows = g.pairs().filter(want).collect()  # two rows a pattern edge at most
    return {(r["lu"], r["lv"]): r for r in rows or () if (r["lu"], r["lv"]) in pairs}


def seed_counts(g: LabeledGraph, pattern: Pattern, dense: list[int]) -> list[int]:
    """For each pattern vertex its smallest (label, neighbour label) list."""
    if pattern.n == 1:
        return [g.vertices.filter(F.col("label") == dense[0]).count()]
    known = label_pairs(g, pattern, dense)
    return [min(known[p]["n"] if (p := (dense[v], dense[w])) in known else 0 for w in pattern.neighbors(v)) for v in range(pattern.n)]


def has_edges(g: LabeledGraph, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are edges."""
    return pairs.join(g.arcs.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_semi")
