"""Blended scores round as every other score does: halves of the thousandfold up."""

import random

import pytest

from textmill.operators.score import blend


@pytest.mark.parametrize("base, wanted", [(0.0045, 0.005), (0.0055, 0.006), (0.0025, 0.003), (0.2344, 0.234), (0.0, 0.0), (1.0, 1.0)])
def test_halves_go_up(base, wanted):
    assert blend(base, "x", []) == wanted


def test_three_decimals_stay():
    rng = random.Random(3)
    assert all(blend(k / 1000, "x", []) == k / 1000 for k in range(1001))
    assert all(abs(blend(x, "x", []) - x) <= 0.0005 + 1e-12 for x in (rng.random() for _ in range(1000)))
