import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.operators import scan as s
from tessera.operators.registration import rotation


def test_axes_have_exact_ends():
    assert len(s.even_axis(s.ANGLES, 0.5)) == 141 and len(s.even_axis(s.SCALES, 0.01)) == 29
    for step in (0.5, 0.3, 7.0, 100.0):
        axis = s.even_axis(s.ANGLES, step)
        assert axis[0] == -35.0 and axis[-1] == 35.0 and (np.diff(axis) <= step + 1e-9).all()
    for bad in (0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            s.even_axis(s.ANGLES, bad)


def test_production_grid(spark):
    poses = s.grid(spark)
    assert poses.count() == 69_513 == poses.select("pose_id").distinct().count()
    assert poses.agg(F.max("pose_id")).first()[0] == 69_512 and poses.groupBy("shard").count().agg(F.max("count")).first()[0] == 512
    row = poses.where("angle = 17.5 AND abs(scale - 0.95) < 1e-9 AND stretch = 1.04 AND direction = 45").first()
    u = np.array([np.cos(np.pi / 4), np.sin(np.pi / 4)])
    want = 0.95 * rotation(17.5) @ (np.eye(2) + 0.04 * np.outer(u, u))
    assert np.allclose([row.a, row.b, row.c, row.d], want.ravel())


def test_fast_sizes():
    smooth = [n for n in range(1, 700) if not [p for p in range(2, n + 1) if n % p == 0 and all(p % q for q in range(2, p)) and p > 5]]
    assert [s.fast_size(n) for n in range(1, 600)] == [next(m for m in smooth if m >= n) for n in range(1, 600)]


def direct(source, target, linear, frame, most):
    """Peaks of one pose from the definition: every pair of corners, every shift."""
    corners = lambda p: [(int(np.floor(x)) + i, int(np.floor(y)) + j, (1 - abs(x - np.floor(x) - i)) * (1 - abs(y - np.floor(y) - j))) for x, y in p for i in (0, 1) for j in (0, 1)]
    moved = source @ linear.T / frame.cell
    origin = s.MARGIN - np.floor(moved.min(0))
    scores = {}
    for (ux, uy, w), (ex, ey, v) in itertools.product(corners(moved + origin), corners((target - frame.low) / frame.cell)):
        for dx, dy in itertools.product(range(-frame.reach, frame.reach + 1), repeat=2):
            at = (ey - uy - dy, ex - ux - dx)
            scores[at] = scores.get(at, 0.0) + w * v * np.exp(-(dx * dx + dy * dy) / (2 * frame.spread**2))
    centre = moved.mean(0)
    inside = lambda at: all(0 <= frame.cell * (c + t + o) < size for c, t, o, size in zip(centre, at[::-1], origin, frame.size))
    scores = {at: v for at, v in scores.items() if inside(at) and v > 1e-9}
    around = lambda at: max(scores.get((at[0] + i, at[1] + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1))
    best = sorted((-round(v, 9), at) for at, v in scores.items() if v >= around(at) - 1e-12)[:most]
    return [(-v, *(frame.cell * (np.array(at[::-1]) + origin) + frame.low)) for v, at in best]


@pytest.mark.parametrize("seed", range(4))
def test_peaks_equal_direct_sums(seed):
    rng = np.random.default_rng(seed)
    source, target = rng.uniform(-40, 60, (9, 2)), rng.uniform(-30, 90, (11, 2))
    linear = np.stack([0.9 * rotation(a) for a in (-30, 0, 20)])
    frame = s.frame_of(source, target, linear, 8.0, 6.0)
    pose, score, shift = frame.peaks(frame.spectrum(target), source, linear, 4)
    for p in range(3):
        want = direct(source, target, linear[p], frame, 4)
        got = [(v, *t) for v, t in zip(score[pose == p], shift[pose == p])]
        assert np.allclose(got, want)


def clouds(spark, n_samples=2):
    rng, left, right, truth = np.random.default_rng(7), [], [], {}
    for i in range(n_samples):
        name, angle, scale, shift = f"m{i}__r{i}", (17.5, -12.0)[i % 2], (1.0, 0.9)[i % 2], np.array([140.0, 96.0 + i])
        src = rng.uniform(0, 200, (40, 2))
        dst = np.r_[src @ (scale * rotation(angle)).T + shift, rng.uniform(0, 350, (20, 2))]
        left += [(name, j, float(x), float(y)) for j, (x, y) in enumerate(src)]
        right += [(name, j, float(x), float(y)) for j, (x, y) in enumerate(dst)]
        truth[name] = (angle, scale, shift)
    schema = "sample_id string, idx long, x double, y double"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), truth


def test_planted_poses_come_first_from_many_shards(spark):
    left, right, truth = clouds(spark)
    poses = s.grid(spark, [-17.5, -12.0, 0.0, 12.0, 17.5], [0.9, 1.0], ((1.0, 0.0), (1.08, 45.0)), shard=3)
    found = s.peaks(left, right, poses)
    assert found.groupBy("sample_id", "pose_id").count().agg(F.max("count")).first()[0] <= 4
    offsets = spark.createDataFrame([(n, 30.0, 5.0) for n in truth], "sample_id string, ox double, oy double")
    best = s.separated(s.placed(found, poses, offsets), 5, ["pose_id", "ty", "tx"]).toPandas()
    assert (best.groupby("sample_id").place.max() == 5).all()
    for name, (angle, scale, shift) in truth.items():
        top = best[(best.sample_id == name) & (best.place == 1)].iloc[0]
        assert (top.angle, top.scale, top.stretch) == (angle, scale, 1.0) and np.hypot(top.tx - shift[0], top.ty - shift[1]) <= 2
        assert np.allclose([top.land_x, top.land_y], scale * rotation(angle) @ (np.array([300.0, 300.0]) - (30, 5)) + (top.tx, top.ty))
    # a shard is a task row: no sample is in one task
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" in plan and "shard" in plan.split("hashpartitioning(sample_id")[1][:40]
    assert found.rdd.getNumPartitions() > len(truth)


def test_shards_change_nothing_and_empty_sides_give_nothing(spark):
    left, right, _ = clouds(spark)
    rows = lambda shard, **o: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in s.peaks(left, right, s.grid(spark, [0.0, 10.0], [0.9, 1.0, 1.1], shard=shard), **o).collect())
    assert rows(4) == rows(512) == rows(100, map_bytes=1)
    assert s.peaks(left.where("false"), right, s.grid(spark, [0.0], [1.0])).count() == 0


@pytest.mark.parametrize("seed,kept", [(0, 5), (1, 30), (2, 1000), (3, 1)])
def test_separation_equals_the_sequential_rule(spark, seed, kept):
    rng = np.random.default_rng(seed)
    n = 1500
    score, angle, land = rng.integers(0, 60, n).astype(float), rng.choice([0, 1, 2, 3, 4.5, 6, 7.5, 30], n), rng.choice([0, 5, 12, 20, 28.28, 40, 55.5], (n, 2)) + rng.choice([0, 100], (n, 1))
    rows = [(f"s{i % 3}", i, float(score[i]), float(angle[i]), float(land[i, 0]), float(land[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, id long, score double, angle double, land_x double, land_y double")
    got = s.separated(df, kept, ["id"])
    for part in range(3):
        own = np.arange(part, n, 3)
        want = [int(own[i]) for i in k.suppress(score[own], angle[own], land[own], kept)]
        assert [r.id for r in got.where(F.col("sample_id") == f"s{part}").orderBy("place").collect()] == want
    assert s.separated(df.where("false"), 3, ["id"]).count() == 0
