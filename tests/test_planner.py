import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from motifspark.plans import generate, planner
from motifspark.plans.planner import Pattern
from motifspark.sources.text import read_pattern, write_pattern


def test_order_is_connected_and_leaves_last():
    p = Pattern.of((9, 2, 3, 18, 8), "01 12 13 14 24")
    order = planner.join_order(p, planner.scores(p, [5, 6, 7, 8, 9]))
    assert order == [1, 2, 4, 0, 3]
    assert [s.anchors for s in planner.steps(p, order)] == [(), (1,), (1, 2), (1,), (1,)]


def test_disconnected_and_bad_patterns():
    with pytest.raises(ValueError):
        planner.join_order(Pattern.of((0, 0, 0), "01"), [1, 1, 1])
    with pytest.raises(ValueError):
        Pattern.of((0,), [(0, 3)])


@given(st.integers(1, 7), st.integers(0, 10_000))
def test_generated_patterns_round_trip(n, seed):
    rng = random.Random(seed)
    p = generate.labelled(generate.topology(n, rng), 12, rng)
    assert p.connected() and len(set(p.labels)) == n
    for encoding in ("native", "degree", "annotated"):
        assert read_pattern(write_pattern(p, encoding)) == p


#: One star of three leaves in the three encodings of the pattern files.
STAR = {
    "native": "t 4 3\nv 0 6\nv 1 12\nv 2 9\nv 3 1\ne 0 1 0\ne 0 2 0\ne 0 3 0\n",
    "degree": "t 1 4 6\n0 6 3 1 2 3 \n1 12 1 0 \n2 9 1 0 \n3 1 1 0 \n",
    "annotated": "t 4 3\nv 0 6 3\nv 1 12 1\nv 2 9 1\nv 3 1 1\ne 0 1\ne 0 2\ne 0 3\nt # -1\n",
}


@pytest.mark.parametrize("encoding", STAR)
def test_pattern_files(encoding):
    assert read_pattern(STAR[encoding]) == Pattern.of((6, 12, 9, 1), "01 02 03")
