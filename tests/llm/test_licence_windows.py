"""Licence notices that are wrapped over lines, inside long lines, or of unseen wording."""

import random

import pyarrow as pa
import pytest

from textmill.llm import license_scan

from .helpers import words


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return license_scan.fit([words(rng, 30) for _ in range(60)])


@pytest.mark.parametrize("family", ["BSD", "GPL-3.0", "MIT", "Apache-2.0"])
def test_wrapped_notices(model, family):
    rng = random.Random(2)
    parts = next(p for p in license_scan.TEMPLATES[family] if len(p) > 1)
    flat = " ".join(parts).split()
    for width in (5, 8, 10):
        wrapped = "\n".join(" ".join(flat[i : i + width]) for i in range(0, len(flat), width))
        hit = model.scan(pa.array([f"{words(rng, 30)}\n\n{wrapped}\n\n{words(rng, 30)}"]))
        assert [h[2] for h in hit if h[2] != "unknown"] == [family] and hit[0][1] == 2, (width, hit)


def test_notices_in_long_lines(model):
    rng = random.Random(3)
    for notice, family in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        hit = model.scan(pa.array([f"{words(rng, 400)} {notice} {words(rng, 400)}"]))
        assert [(h[1], h[2]) for h in hit] == [(0, family)], hit
