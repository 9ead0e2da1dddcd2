import random

import pytest

from motifspark import graph as graphs
from motifspark.operators import direct, matcher
from motifspark.plans.planner import Pattern

LABELS = {0: 4, 1: 9, 2: 9, 3: 12}
PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3), (1, 1)]
PATTERNS = [((3, 1, 2), "01 02 12"), ((0, 1, 1), "01 02"), ((3, 2, 1, 1), "01 02 03 12 13"), ((3, 1, 0, 2), "01 12 03 13"), ((0, 1, 2, 3), "01 12 23 03"), ((1, 1, 0), "01 02 12"), ((1,), ""), ((2, 1, 1, 3), "01 02 03")]


def tables(spark, seed):
    """Tables of keys with repeats, nulls, loops and keys of no vertex; vertices with repeats."""
    rng = random.Random(seed)
    key = lambda x, label: x * 8 + label
    v = {x: [(key(i, x),) for i in range(n)] + [(key(0, x),), (None,)] for x, n in LABELS.items()}
    e = {(a, b): [(key(rng.randrange(LABELS[a] + 1), a), key(rng.randrange(LABELS[b] + 1), b)) for _ in range(40)] + [(None, key(0, b)), (key(0, a), None)] for a, b in PAIRS}
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    g = direct.DirectGraph({x: frame(r, "id long") for x, r in v.items()}, {x: frame(r, "u long, v long") for x, r in e.items()})
    vertices = frame([(i[0], x) for x, r in v.items() for i in r if i[0] is not None], "id long, raw_label int")
    return g, graphs.build(vertices, frame([x for r in e.values() for x in r], "src long, dst long"))


@pytest.mark.parametrize("few", [direct.FEW, 0])
def test_direct_equals_index(spark, few, monkeypatch):
    monkeypatch.setattr(direct, "FEW", few)
    monkeypatch.setattr(direct, "HEAVY", direct.HEAVY if few else 2)
    g, index = tables(spark, 3)
    index.persist()
    for labels, edges in PATTERNS:
        p = Pattern.of(labels, edges)
        got = sorted(tuple(r) for r in direct.match(g, p).collect())
        assert got == sorted(tuple(r) for r in matcher.match(index, p).collect()), (labels, edges)
    assert direct.match(g, Pattern.of((0, 2), "01")).count() == direct.match(g, Pattern.of((0, 9), "01")).count() == 0
    index.unpersist()


def test_direct_orders_by_rows_not_by_candidates(spark):
    """Few nations and suppliers, many orders: suppliers times customers of a nation are the rows to avoid."""
    g = direct.DirectGraph({}, {})
    g._sizes |= {1: 25, 2: 900_000, 3: 60_000, 4: 1_200_000, 5: 9_000_000, (5, 3): 36_000_000, (5, 4): 36_000_000, (4, 3): 36_000_000, (3, 1): 60_000, (1, 2): 900_000, (5, 2): 9_000_000}
    g._sizes |= {k[::-1]: n for k, n in g._sizes.items() if isinstance(k, tuple)}
    cycle, diamond = Pattern.of((5, 3, 1, 2), "01 12 23 03"), Pattern.of((5, 4, 3, 3), "01 02 03 12 13")
    for p in (cycle, diamond):
        own = direct.order(g, p)
        assert max(n for n, _ in direct.estimates(g, p, direct.planner.steps(p, own))) < 4e8
    # The order by candidates pairs each supplier with the customers of its nation.
    plain = direct.planner.steps(cycle, direct.planner.join_order(cycle, direct.planner.scores(cycle, [9_000_000, 60_000, 25, 900_000])))
    assert max(n for n, _ in direct.estimates(g, cycle, plain)) > 2e9


def test_entity_patterns_build_no_index(spark):
    from motifspark import catalog, testgraphs

    before = dict(testgraphs._kept)
    catalog.QUERIES["match_two_suppliers"](spark, "/root/testdata/sf0.001").count()
    assert testgraphs._kept == before  # an index of all arcs took the disk


@pytest.mark.parametrize("long", [4, 256])
def test_lists_equal_index(spark, long, monkeypatch):
    """Lists cut and lists taken apart lose nothing: vertices have more neighbours than ``long``, and fewer."""
    monkeypatch.setattr(direct, "FEW", 0)
    monkeypatch.setattr(direct, "LONG", long)
    asked = []
    listed = direct._listed
    monkeypatch.setattr(direct, "_listed", lambda *a: asked.append(a[6:]) or listed(*a))
    g, index = tables(spark, 5)
    index.persist()
    for labels, edges in PATTERNS[:1] + PATTERNS[2:4]:
        p = Pattern.of(labels, edges)
        got = sorted(tuple(r) for r in direct.match(g, p).collect())
        assert got == sorted(tuple(r) for r in matcher.match(index, p).collect()), (labels, edges)
    index.unpersist()
    assert (long == 4) in {hubs for hubs, _ in asked} and {alone for _, alone in asked} == {False, True}


def test_closing_deals_no_row_for_each_neighbour(spark, monkeypatch):
    """Orders of eight parts and eight suppliers: each part's row would meet each supplier of its order, and does so as one list."""
    monkeypatch.setattr(direct, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = 8
    lines = spark.range(100 * n).selectExpr(f"(id div {n}) * 8 + 5 as o", "(id * 7 % 50) * 8 + 4 as p", "(id * 11 % 390) * 8 + 3 as s")
    ids = lambda c: lines.select(lines[c].alias("id")).distinct()
    pair = lambda a, b: lines.select(lines[a].alias("u"), lines[b].alias("v"))
    g = direct.DirectGraph({5: ids("o"), 4: ids("p"), 3: ids("s")}, {(5, 4): pair("o", "p"), (5, 3): pair("o", "s"), (4, 3): pair("p", "s")})
    df = direct.match(g, Pattern.of((5, 4, 3, 3), "01 02 03 12 13"))
    sc = spark.sparkContext
    sc.setJobGroup("dealt", "dealt")
    df.collect()
    sc._jsc.clearJobGroup()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in known.getJobIdsForGroup("dealt") for s in known.getJobInfo(j).stageIds}
    most = max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert most < 3 * 100 * n  # by rows: 100 * n * n


def test_pairs_of_a_large_group_take_little_room(spark, tmp_path):
    """Each row of the large group met a few values in turn compresses; each of a few met all of them took 11 bits and more a pair."""
    n = 2100
    df = spark.range(n).selectExpr("9L as m0", "id * 8 + 2 as m1")
    direct._paired(df, ["m0"], "m1", "m2", n, n * n).write.parquet(str(tmp_path / "pairs"))
    out = spark.read.parquet(str(tmp_path / "pairs"))
    assert out.distinct().count() == out.filter("m1 <> m2").count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.8 * n * n
