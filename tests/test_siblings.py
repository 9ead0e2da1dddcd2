import random

import pytest

from motifspark import graph as graphs
from motifspark.operators import reorder, siblings


@pytest.mark.parametrize("part, pairs", [(3_000_000, 2_000_000), (40, 5)])
def test_siblings_equal_index(spark, monkeypatch, part, pairs):
    monkeypatch.setattr(siblings, "PART", part)
    monkeypatch.setattr(siblings, "PAIRS", pairs)
    rng = random.Random(3)
    labels = [rng.randrange(2) for _ in range(40)]
    edges = [(a, b) for a in range(40) for b in range(a) if rng.random() < 0.2 or b == 0]
    g = graphs.build(spark.createDataFrame(list(enumerate(labels)), "id long, raw_label int"), spark.createDataFrame(edges, "src long, dst long"))
    arcs = spark.createDataFrame([(u, labels[u], v) for a, b in [*edges, *edges[:30]] for u, v in ((a, b), (b, a))], "u long, lu int, v long")
    want, got = ({tuple(r) for r in x.collect()} for x in (reorder.top_common(g, 5), siblings.top_common(arcs, 5)))
    assert got == want
    assert siblings.top_common(arcs.limit(0), 5).count() == 0


def test_top_siblings_build_no_index(spark):
    from motifspark import catalog, testgraphs

    before = dict(testgraphs._kept)
    assert catalog.QUERIES["topk_common_neighbors"](spark, "/root/testdata/sf0.001").count() > 0
    assert testgraphs._kept == before  # an index and all pairs of siblings took the disk
