import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from revscope.operators import folds


def gears(near, valid=None):
    return folds.debounced_gears(np.array(valid if valid is not None else [True] * len(near)), np.array(near)).tolist()


def test_three_rows_confirm():
    assert gears([2, 2, 2, 2]) == [0, 0, 2, 2]
    assert gears([2, 2, 3, 2, 2, 2]) == [0, 0, 0, 0, 0, 2]


def test_outside_clears_after_three_or_four():
    assert gears([2, 2, 2, 0, 0, 0]) == [0, 0, 2, 2, 2, 0]
    assert gears([2, 2, 2, 3, 0, 0, 0, 0]) == [0, 0, 2, 2, 2, 2, 2, 0]


def test_no_speed_keeps_the_gear_and_drops_the_pending():
    assert gears([2, 2, 2, 3, 3, 0, 3, 3, 3], [True] * 5 + [False] + [True] * 3) == [0, 0, 2, 2, 2, 2, 2, 2, 3]


@given(st.lists(st.integers(0, 200), unique=True), st.integers(1, 30))
def test_spacing_follows_what_was_kept(rows, gap):
    rows = np.array(sorted(rows), dtype=np.int64)
    kept = rows[folds.spaced(rows, gap)]
    assert (np.diff(kept) >= gap).all()
    for r in set(rows.tolist()) - set(kept.tolist()):
        assert any(0 < r - k < gap for k in kept.tolist())


def test_alternation():
    rows, kinds = np.array([0, 50, 100, 120, 200]), np.array(["a", "a", "b", "a", "a"])
    assert folds.alternating(rows, kinds, 40).tolist() == [True, False, True, False, True]


def test_hunting_skips_its_own_reversals():
    rows = np.arange(6) * 20
    up = np.array([True, False] * 3)
    args = (rows, np.full(6, 3), np.full(6, 4), up)
    assert folds.hunting_episodes(*args, np.full(6, 10.0)) == [(0, 5)]
    assert folds.hunting_episodes(*args, np.full(6, 80.0)) == []
    assert folds.hunting_episodes(*args, np.full(6, np.nan)) == [(0, 5)]
