import itertools
import random

import pytest

from motifspark.operators import triangles


@pytest.mark.parametrize("part, ends", [(2_000_000, 4_000_000), (20, 3)])
def test_triangles_equal_brute_force(spark, monkeypatch, part, ends):
    monkeypatch.setattr(triangles, "PART", part)
    monkeypatch.setattr(triangles, "ENDS", ends)
    rng = random.Random(7)
    edges = {tuple(sorted(rng.sample(range(-5, 35), 2))) for _ in range(220)} | {(-5, b) for b in range(-4, 35)}
    want = sum({(a, b), (a, c), (b, c)} <= edges for a, b, c in itertools.combinations(range(-5, 35), 3))
    df = spark.createDataFrame([*edges, *list(edges)[:50]], "u long, v long")
    assert triangles.count(df).collect() == [(6 * want,)]
    assert triangles.count(df.limit(0)).collect() == [(0,)]


def test_unlabelled_triangles_build_no_index(spark):
    from motifspark import catalog, testgraphs

    before = dict(testgraphs._kept)
    assert catalog.QUERIES["count_unlabelled_triangles"](spark, "/root/testdata/sf0.001").first()[0] == 755_808
    assert testgraphs._kept == before  # an index and all paths of two edges took the disk


def test_no_part_is_large_where_ids_say_nothing(spark, monkeypatch):
    """Neighbours' ids lie anywhere: lists sent whole made each part nearly all of the graph."""
    from pyspark.sql import functions as F
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(triangles, "PART", 1000)
    rng = random.Random(11)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(6000)}
    held, plain = [], GroupedData.applyInPandas

    def counted(grouped, *a):
        keys = [c for c in grouped._df.columns if c in ("part", "a", "b", "c")]
        size = F.size("nbrs") if "nbrs" in grouped._df.columns else F.col("n")
        held.extend(r[-1] for r in grouped._df.groupBy(*keys).agg(F.sum(size)).collect())
        return plain(grouped, *a)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    later = {}
    for a, b in edges:
        later.setdefault(a, set()).add(b)
    want = sum(len(later.get(a, set()) & later.get(b, set())) for a, b in edges)
    assert triangles.count(spark.createDataFrame([*edges], "u long, v long")).collect() == [(6 * want,)]
    assert len(held) > 1 and max(held) <= 1000


@pytest.mark.parametrize("near", [True, False])
def test_ranges_follow_the_edges_between_them(near):
    """Neighbours nearby: an edge goes to few parts. Anywhere: to as many as there are ranges, and these are few."""
    import numpy as np

    n = np.zeros((64, 64), np.int64)
    for a in range(64):
        n[a, a : a + 2 if near else 64] = 2000
    first, parts = triangles.planned(n, 30_000)
    sizes = np.add.reduceat(np.add.reduceat(n, first, 0), first, 1)
    own = [sum(sizes[p] for p in triangles.pairs(*x)) for x in parts]
    assert max(own) <= 30_000 and sum(own) <= (4 if near else 1.2 * (6 * n.sum() / 30_000) ** 0.5) * n.sum()
