import itertools
import random

import pytest
from pyspark.sql import functions as F

from motifspark import graph as graphs
from motifspark.functions import stats
from motifspark.graph import build
from motifspark.operators import index, matcher, reorder, results
from motifspark.plans import generate
from motifspark.plans.planner import Pattern
from motifspark.sources import text


def graph(spark, labels, edges):
    v = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id long, raw_label int")
    return build(v, spark.createDataFrame(edges, "src long, dst long"))


@pytest.fixture(scope="module")
def micro(spark):
    return graph(spark, range(6), [(0, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (4, 2), (3, 3)])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(labels, edges, p, injective=True):
    e = {x for a, b in edges for x in ((a, b), (b, a))}
    out = []
    for m in itertools.product(range(len(labels)), repeat=p.n):
        if all(labels[m[v]] == p.labels[v] for v in range(p.n)) and all((m[a], m[b]) in e for a, b in p.edges) and (not injective or len(set(m)) == p.n):
            out.append(m)
    return sorted(out)


def test_micro_index(micro):
    assert rows(index.neighborhood(micro)) == [(0, 2, 0), (1, 61, 1), (2, 26, 6), (3, 6, 9), (4, 6, 11), (5, 2, 13)]
    assert rows(stats.graph_summary(micro)) == [(6, 7, 6, 5, 2, 1)]
    own = [r[2] for r in rows(index.slots(micro).select("id", "neighbor_label", "ordinal"))]
    assert own == [0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 1, 3, 2, 4]
    assert [r[1] for r in rows(stats.label_offsets(micro))] == [0, 1, 2, 3, 4, 5]


def test_loops_repeats_and_unknown_ends_are_dropped(spark):
    g = graph(spark, [0, 0], [(0, 1), (1, 0), (0, 0), (0, 9)])
    assert rows(g.arcs.select("u", "v")) == [(0, 1), (1, 0)]


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert stats.graph_summary(g).first()["vertices"] == 0
    assert matcher.match(g, Pattern.of((0, 1), "01")).count() == 0
    assert matcher.count(g, Pattern.of((0, 1, 2), "01 02")).first()[0] == 0


@pytest.mark.parametrize("seed", range(3))
def test_strategies_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    labels = [rng.randrange(3) for _ in range(12)]
    edges = [(a, b) for a in range(12) for b in range(a) if rng.random() < 0.4]
    g = graph(spark, labels, edges).persist()
    for n in (1, 2, 3, 4):
        p = Pattern(tuple(rng.randrange(3) for _ in range(n)), generate.topology(n, rng).edges)
        want = brute(labels, edges, p)
        for strategy in ("join", "intersect"):
            assert rows(matcher.match(g, p, strategy)) == want
        assert rows(matcher.match(g, p, semantics="homomorphism")) == brute(labels, edges, p, False)
        assert matcher.count(g, p).first()[0] == len(want)
    g.unpersist()


def test_unlabelled_counts(spark):
    k4 = graph(spark, [0] * 4, [(a, b) for a in range(4) for b in range(a)])
    for edges, n, want in (("01 02 12", 3, 24), ("01 12 23 03", 4, 24), ("01 02 03 12 13 23", 4, 24), ("01 02", 3, 24)):
        assert matcher.count(k4, Pattern.of((0,) * n, edges)).first()[0] == want


def test_unknown_label_limit_and_disconnected(micro):
    assert matcher.match(micro, Pattern.of((1, 77), "01")).count() == 0
    assert matcher.match(micro, Pattern.of((1, 2), "01"), limit=1).count() == 1
    with pytest.raises(ValueError):
        matcher.match(micro, Pattern.of((0, 1, 2), "01"))


def test_files_round_trip(spark, micro, tmp_path):
    text.write_graph(micro, f"{tmp_path}/text")
    index.save(micro, f"{tmp_path}/index")
    for g in (text.read_graph(spark, f"{tmp_path}/text"), index.load(spark, f"{tmp_path}/index")):
        assert rows(g.arcs.select("u", "lu", "v", "lv")) == rows(micro.arcs.select("u", "lu", "v", "lv"))


def test_reorderings_are_label_contiguous_permutations(spark):
    rng = random.Random(4)
    labels = [rng.randrange(3) for _ in range(40)]
    g = graph(spark, labels, [(a, b) for a in range(40) for b in range(a) if rng.random() < 0.2])
    for df in (reorder.by_degree(g), reorder.hubs_last(g, 2), reorder.locality(g, 2, run=8), index.partition_ids(g)):
        out = df.orderBy("new_id").collect()
        assert [r["new_id"] for r in out] == list(range(40))
        assert [r["label"] for r in out] == sorted(r["label"] for r in out)
        assert sorted(r["id"] for r in out) == list(range(40))


def test_isolated_vertices_have_degree_zero(spark):
    g = graph(spark, [0, 1], [])
    assert rows(stats.vertex_degree(g)) == [(0, 0), (1, 0)]
    assert rows(stats.partition_max_degree(g).select(F.col("partition_max_degree"))) == [(0,), (0,)]


def test_more_labels_than_a_mask_has_bits(spark):
    rng = random.Random(8)
    labels = [i % 70 for i in range(140)]
    edges = [(0, b) for b in range(1, 140)] + [(a, b) for a in range(1, 140) for b in range(1, a) if rng.random() < 0.02]
    g = graph(spark, labels, edges)
    own = rows(index.slot_lookup(g))
    assert [r[2] for r in own] == list(range(len(own))) and len([r for r in own if r[0] == 0]) == 70
    p = Pattern.of((0, 69, 64), "01 02 12")
    e = {x for a, b in edges for x in ((a, b), (b, a))}
    want = [(a, b, c) for a in (0, 70) for b in (69, 139) for c in (64, 134) if {(a, b), (a, c), (b, c)} <= e]
    assert rows(matcher.match(g, p)) == want


def test_hubs_are_cut_into_lists_and_keys(spark, monkeypatch):
    rng = random.Random(9)
    labels = [rng.randrange(2) for _ in range(30)]
    edges = [(0, b) for b in range(1, 30)] + [(1, b) for b in range(2, 30)] + [(a, b) for a in range(2, 30) for b in range(2, a) if rng.random() < 0.1]
    p = Pattern.of((labels[0], labels[1], 0, 1), "01 02 12 03 13")
    g = graph(spark, labels, edges)
    want, common, entries = rows(matcher.match(g, p)), rows(reorder.common_neighbors(g)), rows(index.adjacency_rows(g))
    assert want == brute(labels, edges, p)
    monkeypatch.setattr(graphs, "LIST", 3)
    monkeypatch.setattr(reorder, "HEAVY", 2)
    g = graph(spark, labels, edges)
    assert g.adjacency().filter("u = 0").count() > 4 and g.adjacency().selectExpr("max(size(nbrs))").first()[0] < 12
    assert rows(matcher.match(g, p, "intersect")) == want and rows(reorder.common_neighbors(g)) == common
    e = {x for a, b in edges for x in ((a, b), (b, a))}
    assert entries == sorted((u, lv, i, v) for u in range(30) for lv in (0, 1) for i, v in enumerate(sorted(v for x, v in e if x == u and g_label(labels, v) == lv)))


def g_label(labels, v):
    return [x for i, x in enumerate(labels) if x not in labels[:i]].index(labels[v])


def brute_locality(labels_of, adj, members, window, labels):
    """The greedy order by its definition, all counts anew for every choice."""
    order = []
    while len(order) < len(members):
        best = None
        for j in members:
            if j in order:
                continue
            score, read, shares = 0.0, {}, False
            for placed in order[::-1][: window - 1]:
                for l in range(labels):
                    both = {v for v in adj[placed] & adj[j] if labels_of[v] == l}
                    if both:
                        shares = True
                        read[l] = read.get(l, sum(labels_of[v] == l for v in adj[j])) + sum(labels_of[v] == l for v in adj[placed])
                        score += len(both) / (read[l] * labels)
            if best is None or (score if shares else -1) > best[0] + 1e-12:
                best = (score if shares else -1, j)
        order.append(best[1])
    return order


@pytest.mark.parametrize("seed", range(3))
def test_locality_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    labels = sorted(rng.randrange(3) for _ in range(40))
    adj = {i: set() for i in range(40)}
    for a, b in itertools.combinations(range(40), 2):
        if rng.random() < 0.15:
            adj[a].add(b)
            adj[b].add(a)
    for label in set(labels):
        members = [i for i in range(40) if labels[i] == label]
        lists = [{l: {v for v in adj[i] if labels[v] == l} for l in {labels[v] for v in adj[i]}} for i in members]
        assert [members[i] for i in reorder.locality_order(lists, 4, 3)] == brute_locality(labels, adj, members, 4, 3)


def test_profile_counts_steps(spark, micro):
    got = results.profile(micro, Pattern.of((1, 2, 3), "01 02 12")).collect()
    assert [r["rows"] for r in got] == [1, 1, 1] and all(r["seconds"] >= 0 for r in got)
    report = results.report(micro, Pattern.of((1, 2, 3), "01 02 12"))
    assert report.embeddings == 1 and sorted(report.order) == [0, 1, 2]


def test_a_match_is_planned_without_a_query(spark, micro):
    micro.catalog()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    matcher.match(micro, Pattern.of((1, 2, 3), "01 02 12"))
    assert store.executionsCount() == before  # the catalog has what it takes


def test_export_without_hubs_lists_them(spark, micro, tmp_path):
    star = graph(spark, [0] * 6, [(0, i) for i in range(1, 6)] + [(1, 2)])
    index.export_without_hubs(star, 3, f"{tmp_path}/x")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/x/hubs").collect()] == ["0 5"]
    assert rows(text.read_graph(spark, f"{tmp_path}/x/graph").arcs.select("u", "v")) == [(1, 2), (2, 1)]
    text.write_labels(micro, f"{tmp_path}/labels")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/labels").collect()] == [f"{i} {i}" for i in range(6)]


def test_large_label_tables_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(graphs, "KNOWN", 2)
    g = graph(spark, [0, 1, 2, 3], [(0, 1), (1, 2), (2, 3), (0, 2)])
    assert g.catalog() == graphs.Catalog(None, None, None)
    assert rows(matcher.match(g, Pattern.of((0, 1, 2), "01 02 12"))) == [(0, 1, 2)]
    assert matcher.match(g, Pattern.of((9, 1), "01")).count() == 0
