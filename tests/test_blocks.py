"""Rows compared in blocks: small blocks and parts give what all pairs give."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, consensus, kernels
from tessera.operators import matching as mt
from tessera.plans import adapters as ad
from tessera.plans import catalog


@pytest.mark.parametrize("seed", [0, 1])
def test_first_and_summed_equal_all_pairs(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=700), rng.normal(size=900)
    value = np.sort(rng.uniform(size=900))[::-1]
    monkeypatch.setattr(blocks, "SLICE", 16)
    near = np.abs(a[:, None] - b) < 0.1
    got = blocks.first_values(lambda i, j: np.abs(a[i, None] - b[j]) < 0.1, value, 700)
    assert got.tolist() == np.where(near, value, -np.inf).max(axis=1).tolist()
    assert blocks.summed(lambda i, j: np.abs(a[i, None] - b[j]) < 0.1, value, 700, 900) == pytest.approx(near @ value)


def candidates(spark, n=200):
    rng = np.random.default_rng(4)
    rows = [("g", f"s{i % 3}", i, float(rng.normal(30, 5)), float(rng.normal(0, 2)), float(rng.normal(300, 50)), float(rng.normal(300, 50))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "subject string, sample_id string, cand_idx long, score double, angle double, land_x double, land_y double")


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    rows, df = candidates(spark)

    def all_of_it():
        poses = df.select("subject", F.col("cand_idx").alias("idx"), F.col("score").alias("weight"), "angle", "land_x", "land_y")
        centres = df.select("subject", F.col("cand_idx").cast("string").alias("sample_id"), (F.col("land_x") / 600).alias("cx"), (F.col("land_y") / 600).alias("cy"))
        found = (consensus.vote_modes(df, ["subject"]), consensus.cluster_modes(poses, ["subject"]), consensus.consistent_by_gate(centres, ["subject"], [0.05, 0.1]), mt.margins(df, "score", "m"))
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()) for f in found]

    whole = all_of_it()
    monkeypatch.setattr(blocks.compare, "__defaults__", (30, 50))
    assert all_of_it() == whole and all(whole)


def test_no_pair_becomes_a_row(spark, sf):
    """The rows between operators stay a few times the input's, where a join of pairs has a share of its square."""
    for name in ("vote_modes", "cluster_modes", "consistency_gate", "soft_margin", "gate_dictionary"):
        assert "_cell" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString(), name
    assert ad.candidates(spark, sf).count() > 0


def test_pose_errors_and_descriptors_make_no_row_a_pair(spark, sf):
    plan = catalog.QUERIES["pose_errors"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    plan = catalog.QUERIES["descriptor_similarity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("cosine") < plan.index("Join")  # what is above the join of pairs only computes
    assert "Aggregate" not in plan[: plan.index("Join")] and "Exchange" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("radius", [0.5, 8.0, 30.0])
def test_nearest_targets_by_growing_radius(radius, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 50, (400, 2)).round(), rng.normal(0, 50, (500, 2)).round()
    d = np.sqrt(((a[:, None] - b) ** 2).sum(-1))
    want = {i: (int(d[i].argmin()), d[i].min()) for i in range(400) if d[i].min() < radius}
    i, j, e = kernels.nearest_targets(a, b, radius, at_once=1000)
    assert dict(zip(i.tolist(), zip(j.tolist(), e.tolist()))) == want


def test_nearest_pairs_of_crowded_fields_stay_small():
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 50, (8000, 2)), rng.normal(0, 50, (8000, 2))
    tracemalloc.start()
    kernels.nearest_pairs(a, b, 30.0)  # five million pairs lie within the radius
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_differences_near_are_those_of_the_window(spark, sf):
    from tessera.operators import candidates as cd

    iv, ex = ad.points(spark, sf, "iv"), ad.points(spark, sf, "ex")
    grid = cd.pose_grid(spark, (-6.0, 6.0, 6.0), (0.95, 1.05, 0.05))
    poses = iv.select("sample_id").distinct().crossJoin(grid).withColumns({"_tx": F.lit(7.0), "_ty": F.lit(-11.0)})
    shown = lambda t: sorted(tuple(r) for r in t.where("abs(dx - 7) <= 25 AND abs(dy + 11) <= 25").collect())
    assert shown(cd.differences_near(iv, ex, poses, 25.0)) == shown(cd.differences(iv, ex, grid)) != []


@pytest.mark.parametrize("method", ["hough", "priors"])
def test_registration_dealt_by_linear_parts_equals_the_whole_search(spark, sf, method):
    from tessera.operators import registration as rg

    iv, ex = ad.points(spark, sf, "iv").where("sample_id = 'm1__r1'"), ad.points(spark, sf, "ex").where("sample_id = 'm1__r1'")
    got = rg.candidates(iv, ex, method, keep=5)
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()
    a, b = (t.orderBy("idx").select("x", "y").toPandas().to_numpy() for t in (iv, ex))
    want = rg.refined(a, b, {"hough": rg.hough, "priors": rg.with_priors}[method](a, b), np.zeros(2), 5)
    assert [(r.score, r.angle) for r in got.orderBy("cand_idx").collect()] == [(s, angle) for s, _, angle, _ in want]
