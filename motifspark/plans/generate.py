"""Workload generators: random connected patterns and distinct labels for them."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from .planner import Pattern


def topology(n: int, rng: random.Random, p: float = 0.6) -> Pattern:
    """A connected simple pattern with all labels 0: each vertex joins each earlier one with
    probability ``p``, and one at least."""
    edges = [(0, 1)] if n > 1 else []
    for v in range(2, n):
        own: list[tuple[int, int]] = []
        while not own:
            own = [(u, v) for u in range(v) if rng.random() < p]
        edges += own
    return Pattern.of((0,) * n, edges)


def labelled(pattern: Pattern, labels: int, rng: random.Random) -> Pattern:
    """The pattern with pairwise distinct labels under ``labels``."""
    if labels < pattern.n:
        raise ValueError("fewer labels than vertices")
    return Pattern(tuple(rng.sample(range(labels), pattern.n)), pattern.edges)


def data_label(id_col: str, labels: int, seed: int = 0) -> Column:
    """A reproducible label for a data vertex."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(labels)).cast("int")
