"""The production scan of samples of many points: sizes from the hull, maps in blocks."""

import tracemalloc

import numpy as np
import pytest

from tessera.operators import scan as s
from tessera.operators.registration import rotation

LINEAR = np.stack([c * rotation(a) for c in (0.85, 1.0, 1.13) for a in np.linspace(-35, 35, 100)])


@pytest.mark.parametrize("points", [np.random.default_rng(0).normal(size=(500, 2)), np.random.default_rng(1).integers(0, 4, (60, 2)) * 1.0, [[3.0, 4.0]], [[1.0, 2.0]] * 3, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], [[1.0, 0.0], [1.0, 5.0], [1.0, 3.0]]])
def test_outer_points_bound_every_linear_part(points):
    points = np.array(points)
    edge = s.outer(points)
    assert {tuple(p) for p in edge} <= {tuple(p) for p in points} and len(edge) <= min(len(points), 40)
    reach = lambda p: np.einsum("pij,nj->pni", LINEAR, p)
    assert np.allclose(reach(edge).min(1), reach(points).min(1)) and np.allclose(reach(edge).max(1), reach(points).max(1))


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_blocks_change_nothing(n, monkeypatch):
    rng = np.random.default_rng(n)
    source, target = rng.normal(0, 50, (n, 2)), rng.normal(0, 50, (300, 2))
    frame = s.frame_of(source, target, LINEAR, 12.0, 6.0)
    origin = s.MARGIN - np.floor(np.einsum("pij,nj->pni", LINEAR[:9], source).min(1) / 12)
    want = np.zeros((9, *frame.template))
    for p, linear in enumerate(LINEAR[:9]):  # the four corners by area, point by point
        for x, y in source @ linear.T / 12 + origin[p]:
            c, r = int(np.floor(x)), int(np.floor(y))
            want[p, r : r + 2, c : c + 2] += np.outer([1 - y + r, y - r], [1 - x + c, x - c])
    for block in (1, 700, 1 << 15):
        monkeypatch.setattr(s, "BLOCK", block)
        assert np.allclose(frame.templates(source, LINEAR[:9], origin), want, atol=1e-9)


def test_memory_does_not_grow_with_the_points():
    rng = np.random.default_rng(3)
    source, target = rng.normal(0, 50, (40_000, 2)), rng.normal(0, 50, (100, 2))
    tracemalloc.start()
    frame = s.frame_of(s.outer(source), target, LINEAR, 12.0, 6.0)
    frame.peaks(frame.spectrum(target), source, LINEAR[:50], 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 << 20  # one array of all moved points alone is 32 MB
