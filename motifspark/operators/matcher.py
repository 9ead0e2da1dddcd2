"""Subgraph matching: one lazy DataFrame, extended by a pattern vertex a step."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import hubs
from ..graph import LabeledGraph
from ..plans import planner
from ..plans.planner import Pattern, Step
from .candidates import candidate_counts, candidates, dense_labels, fits, has_neighbors, label_pairs


#: Neighbours of a label up to which whole lists go along with the rows of a match.
SHORT = 256


def empty(g: LabeledGraph, pattern: Pattern) -> DataFrame:
    schema = T.StructType([T.StructField(f"m{v}", T.LongType()) for v in range(pattern.n)])
    return g.vertices.sparkSession.createDataFrame([], schema)


def plan(g: LabeledGraph, pattern: Pattern, dense: list[int] | None = None) -> tuple[list[Step], list[int]]:
    """The steps, and the candidate counts they are ordered by."""
    dense = dense or dense_labels(g, pattern)
    counts = candidate_counts(g, pattern, dense) if dense else [0] * pattern.n
    return planner.steps(pattern, planner.join_order(pattern, planner.scores(pattern, counts))), counts


def match(g: LabeledGraph, pattern: Pattern, strategy: str = "auto", semantics: str = "isomorphism", leaf_injective: bool = True,
          limit: int | None = None, seeds: DataFrame | None = None, only: set[int] | None = None) -> DataFrame:
    """Every embedding, as m0..m{n-1} in the pattern's vertex order.

    ``strategy``: "join" reads the neighbours of the anchor with fewest of them and closes further
    edges by semi-joins on both ends, so that rows stay narrow whatever the degrees; "intersect"
    intersects adjacency lists; "auto" intersects where no list of the step's labels is longer than
    ``SHORT``, as the index's statistics say, and joins elsewhere.
    ``semantics``: "isomorphism" matches different data vertices, "homomorphism" may repeat
    them; ``leaf_injective=False`` lets only the pattern's leaves repeat others. ``seeds``
    (id) restricts the first matched vertex. ``only``: stop after these pattern vertices.
    """
    dense = _checked(g, pattern, strategy, semantics)
    if dense is None:
        return empty(g, pattern)
    todo, counts = plan(g, pattern, dense)
    if not all(counts):
        return empty(g, pattern)
    df = None
    for df, _ in prefixes(g, pattern, dense, todo, strategy, semantics, leaf_injective, seeds, only):
        pass
    df = df.select(*sorted(df.columns, key=lambda c: int(c[1:])))
    return df.limit(limit) if limit is not None else df


def _checked(g: LabeledGraph, pattern: Pattern, strategy: str, semantics: str) -> list[int] | None:
    if strategy not in ("auto", "join", "intersect") or semantics not in ("isomorphism", "homomorphism"):
        raise ValueError("unknown strategy or semantics")
    if not pattern.n or not pattern.connected():
        raise ValueError("the pattern must be connected")
    return dense_labels(g, pattern)


def prefixes(g: LabeledGraph, pattern: Pattern, dense: list[int], todo: list[Step], strategy: str = "auto", semantics: str = "isomorphism",
             leaf_injective: bool = True, seeds: DataFrame | None = None, only: set[int] | None = None) -> Iterator[tuple[DataFrame, Step]]:
    """The lazy DataFrame after each step: the embeddings of the vertices matched so far, all of them candidates."""
    first = todo[0].vertex
    df = candidates(g, pattern, dense, first).select(F.col("id").alias(f"m{first}"))
    if seeds is not None:
        df = df.join(seeds.select(F.col("id").alias(f"m{first}")).distinct(), f"m{first}", "left_semi")
    yield df, todo[0]
    fan = label_pairs(g, pattern, dense)
    for step in todo[1:]:
        if only is not None and step.vertex not in only:
            continue
        df = extend(g, df, pattern, dense, step, strategy, fan)
        if semantics == "isomorphism" and (leaf_injective or not step.leaf):
            for other in step.same:
                df = df.filter(F.col(f"m{step.vertex}") != F.col(f"m{other}"))
        yield df, step


def extend(g: LabeledGraph, df: DataFrame, pattern: Pattern, dense: list[int], step: Step, strategy: str, fan: dict | None = None) -> DataFrame:
    """The rows of ``df``, each with every candidate next to all the step's anchors."""
    label, fan = dense[step.vertex], fan or {}
    size = lambda a, of, none: of(fan[dense[a], label]) if (dense[a], label) in fan else none
    # The anchor of least mean degree to the new label is read, the others are tested.
    anchors = sorted(step.anchors, key=lambda a: size(a, lambda r: r["ends"] / r["n"], 0.0))
    new, (first, *more) = f"m{step.vertex}", anchors
    if strategy == "auto":
        strategy = "intersect" if all(size(a, lambda r: r["most"], SHORT + 1) <= SHORT for a in anchors) else "join"
    if more and strategy == "intersect":
        lists = []
        for k, a in enumerate(anchors):
            # A hub has several lists, each vertex in one of them: the pairs of lists part the intersection.
            own = g.adjacency().filter((F.col("lu") == dense[a]) & (F.col("lv") == label)).select(F.col("u").alias(f"m{a}"), F.col("nbrs").alias(f"_n{k}"))
            df = df.join(own, f"m{a}")
            lists.append(F.col(f"_n{k}"))
        df = df.withColumn(new, F.explode(reduce(F.array_intersect, lists))).drop(*(f"_n{k}" for k in range(len(lists))))
        if len(anchors) == pattern.degree(step.vertex):
            return df  # all neighbours are matched: the labels are there
        return df.join(g.masks().filter(fits(pattern, dense, step.vertex)).select(F.col("id").alias(new)), new, "left_semi")
    links = g.links().filter((F.col("lu") == dense[first]) & (F.col("lv") == label) & has_neighbors(pattern, dense, step.vertex))
    df = df.join(links.select(F.col("u").alias(f"m{first}"), F.col("v").alias(new)), f"m{first}")
    for a in more:
        close = g.links().filter((F.col("lu") == dense[a]) & (F.col("lv") == label)).select(F.col("u").alias(f"m{a}"), F.col("v").alias(new))
        df = df.join(close, [f"m{a}", new], "left_semi")
    return df


def from_hubs(g: LabeledGraph, pattern: Pattern, least: int, **kw) -> DataFrame:
    """Embeddings whose first matched vertex is a hub."""
    return match(g, pattern, seeds=hubs(g, least), **kw)


def count(g: LabeledGraph, pattern: Pattern, factorized: bool = True, **kw) -> DataFrame:
    """embeddings: how many there are, as one row.

    Leaves need not be spelled out: where leaves of a label hang on one parent and no core
    vertex has that label, a core match stands for the product of falling factorials of the
    parents' degrees to the labels. Other patterns are expanded and counted.
    """
    leaves = pattern.leaves()
    core = [v for v in range(pattern.n) if v not in leaves]
    groups: dict[tuple[int, int], int] = {}
    for v in leaves:
        key = (pattern.neighbors(v)[0], pattern.labels[v])
        groups[key] = groups.get(key, 0) + 1
    by_label: dict[int, set[int]] = {}
    for parent, label in groups:
        by_label.setdefault(label, set()).add(parent)
    simple = core and leaves and all(len(p) == 1 for p in by_label.values()) and not {pattern.labels[v] for v in core} & set(by_label)
    dense = dense_labels(g, pattern)
    if not factorized or not simple or dense is None:
        return match(g, pattern, **kw).agg(F.count("*").alias("embeddings"))
    df = match(g, pattern, only=set(core), **kw)
    number = dict(zip(pattern.labels, dense))
    product = F.lit(1).cast("long")
    for k, ((parent, label), r) in enumerate(sorted(groups.items())):
        own = g.degrees().filter((F.col("lu") == dense[parent]) & (F.col("lv") == number[label])).select(F.col("u").alias(f"m{parent}"), F.col("deg").alias(f"_d{k}"))
        df = df.join(own, f"m{parent}")
        for i in range(r):
            product = product * (F.col(f"_d{k}") - i)
    return df.agg(F.coalesce(F.sum(product), F.lit(0)).cast("long").alias("embeddings"))
