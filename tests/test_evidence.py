import numpy as np
import pytest

from tessera.functions import geometry as g
from tessera.operators import evidence as e
from tessera.operators import kernels as k
from tessera.operators.registration import rotation


@pytest.mark.parametrize("seed", range(6))
def test_masked_correlation_equals_corr_of_every_overlap(seed):
    rng = np.random.default_rng(seed)
    image, other = 50 + rng.random((9, 7)), rng.random((5, 8)) * 9 - 100
    mask, other_mask = rng.random(image.shape) < 0.7, rng.random(other.shape) < 0.6
    ncc, n = e.masked_correlation(image, mask, other, other_mask)
    for i, j in np.ndindex(*ncc.shape):
        row, col = i - 4, j - 7
        pairs = [(image[r, c], other[r - row, c - col]) for r in range(9) for c in range(7) if 0 <= r - row < 5 and 0 <= c - col < 8 and mask[r, c] and other_mask[r - row, c - col]]
        assert n[i, j] == len(pairs)
        if len(pairs) >= 3:
            assert ncc[i, j] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1], abs=1e-7)
        elif len(pairs) < 2:
            assert np.isnan(ncc[i, j])


def test_flat_overlaps_have_no_correlation():
    flat = np.ones((4, 4))
    assert np.isnan(e.masked_correlation(flat, flat > 0, flat, flat > 0)[0]).all()
    nothing = np.zeros((4, 4), bool)
    assert np.isnan(e.masked_correlation(flat, nothing, flat, flat > 0)[0]).all()


def test_bands_keep_structure_between_the_deviations():
    y, x = np.indices((120, 120))
    slow, fine, middle = (np.sin(2 * np.pi * x / period) for period in (110, 3, 18))
    strength = lambda v: np.abs(e.band(v)[40:80, 40:80]).max()
    assert strength(middle) > 0.5 and strength(slow) < 0.25 and strength(fine) < 0.05 and strength(np.full((120, 120), 7.0)) < 1e-9


@pytest.mark.parametrize("shift", [(0.0, 0.0), (5.0, -3.0), (-7.4, 2.3), (0.5, 11.25)])
def test_phase_shifts_come_back(shift):
    rng = np.random.default_rng(3)
    spots = rng.uniform(20, 110, (60, 2))
    y, x = np.indices((130, 130))
    draw = lambda by: sum(np.exp(-((x - px - by[0]) ** 2 + (y - py - by[1]) ** 2) / 8) for px, py in spots)
    dx, dy, height = e.phase_shift(draw((0, 0)), 3 * draw(shift) + 10)
    assert abs(dx - shift[0]) < 0.35 and abs(dy - shift[1]) < 0.35 and height > 0.05


def test_chains_are_products_of_their_poses(spark):
    rng, rows = np.random.default_rng(4), []
    poses = {(name, i): np.c_[rotation(rng.uniform(-9, 9)), rng.uniform(-5, 5, 2)] for name, n in (("a", 13), ("b", 1), ("c", 16)) for i in range(1, n + 1)}
    for (name, i), m in poses.items():
        rows.append((name, i, *map(float, m.ravel())))
    df = spark.createDataFrame(rows, "subject string, pos long, a double, b double, tx double, c double, d double, ty double")
    got = e.chained(df.select("subject", "pos", e.F.struct(*g.POSE).alias("pose")), ["subject"]).collect()
    assert len(got) == len(rows)
    for r in got:
        whole = np.eye(3)
        for i in range(1, r.pos + 1):
            whole = whole @ np.r_[poses[r.subject, i], [[0, 0, 1]]]
        assert np.allclose([r.pose[n] for n in g.POSE], whole[:2].ravel())
    assert e.chained(df.where("false").select("subject", "pos", e.F.struct(*g.POSE).alias("pose")), ["subject"]).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_sampling_recovers_a_pose_where_the_trimmed_fit_fails(seed):
    rng = np.random.default_rng(seed)
    source = rng.uniform(0, 300, (100, 2))
    pose = np.c_[0.95 * rotation(20), [40.0, -10.0]]
    target = k.moved(source, pose) + rng.normal(0, 0.3, source.shape)
    target[:60] = rng.uniform(0, 400, (60, 2))
    found, agree = e.sampled_affine(source, target, 2.0)
    assert np.abs(k.moved(source, found) - k.moved(source, pose)).max() < 1.5 and agree[60:].all() and agree[:60].sum() <= 3
    again = e.sampled_affine(source, target, 2.0)
    assert (again[0] == found).all() and (again[1] == agree).all()
    trimmed = k.fit_affine(source, target, 2.0)
    assert trimmed is None or np.abs(k.moved(source, trimmed) - k.moved(source, pose)).max() > 5


def test_sampling_stops_early_and_survives_degenerate_points():
    line = np.c_[np.arange(20.0), np.arange(20.0)]
    assert e.sampled_affine(line, line, 1.0)[0] is None and e.sampled_affine(line[:2], line[:2], 1.0)[0] is None
    square = np.random.default_rng(0).uniform(0, 9, (50, 2))
    pose, agree = e.sampled_affine(square, square, 0.1, most=64)
    assert np.allclose(pose, np.c_[np.eye(2), [0, 0]]) and agree.all()
