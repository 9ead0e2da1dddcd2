"""What a match reports about itself."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..graph import LabeledGraph
from ..plans import planner
from ..plans.planner import Pattern
from . import matcher


@dataclass
class MatchReport:
    candidates: list[int]
    order: list[int]
    plan: str
    embeddings: int
    plan_s: float
    match_s: float


def report(g: LabeledGraph, pattern: Pattern, **kw) -> MatchReport:
    """Plan and count a match, with the times of both."""
    t = time.perf_counter()
    todo, counts = matcher.plan(g, pattern)
    planned = time.perf_counter()
    n = matcher.count(g, pattern, **kw).first()["embeddings"]
    return MatchReport(counts, [s.vertex for s in todo], planner.show(todo), n, planned - t, time.perf_counter() - planned)


def profile(g: LabeledGraph, pattern: Pattern, order: list[int] | None = None, **kw) -> DataFrame:
    """step, vertex, candidates, rows, seconds: each step's embeddings of the vertices matched so far, and the time to count them.

    A step's rows are counted anew from the first on, as one query; ``order`` takes the place of the planned one.
    """
    dense = matcher.dense_labels(g, pattern)
    out: list[tuple[int, int, int, int, float]] = []
    if dense is not None:
        counts = matcher.candidate_counts(g, pattern, dense)
        todo = planner.steps(pattern, order) if order else matcher.plan(g, pattern, dense)[0]
        for i, (df, step) in enumerate(matcher.prefixes(g, pattern, dense, todo, **kw)):
            t = time.perf_counter()
            n = df.count()
            out.append((i, step.vertex, counts[step.vertex], n, time.perf_counter() - t))
    return g.vertices.sparkSession.createDataFrame(out, "step int, vertex int, candidates long, rows long, seconds double")
