"""The registered registrations find fields turned and scaled anywhere in their production grids."""

import numpy as np
import pytest

from tessera.operators import registration as r
from tessera.plans import adapters, catalog


@pytest.mark.parametrize(
    "name, linear",
    [
        ("hough_register", 0.87 * r.rotation(30)),
        ("fft_scan", r.rotation(-20.5)),
        ("register_ncc", 1.05 * r.rotation(-9) @ np.array(r.LINEAR_PRIORS[0])),
        ("register_with_priors", 1.05 * r.rotation(-5) @ np.array(r.LINEAR_PRIORS[0])),
    ],
)
def test_a_turned_field_is_found(spark, monkeypatch, name, linear):
    rng = np.random.default_rng(3)
    src = rng.uniform(0, 300, (60, 2))
    dst = src @ linear.T + (40, 25)
    frame = lambda p: spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(p)], "sample_id string, idx long, x double, y double")
    monkeypatch.setattr(adapters, "points", lambda spark, sf_dir, which: frame(src if which == "iv" else dst))
    best = catalog.QUERIES[name](spark, "").toPandas().sort_values("score").iloc[-1]
    assert abs(best.angle - np.degrees(np.arctan2(linear[1, 0], linear[0, 0]))) < 0.6
    if name != "fft_scan":
        assert np.allclose(best[list("abcd")].to_numpy(float), linear.ravel(), atol=0.01) and np.allclose(best[["tx", "ty"]].to_numpy(float), (40, 25), atol=2)
