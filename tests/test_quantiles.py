"""Quantiles found span by span are those of all values at once, and no aggregate holds a group's values."""

import random

from pyspark.sql import functions as F

from tessera.operators import metrics as ms


def test_quantiles_equal_those_of_whole_groups(spark):
    rng = random.Random(3)
    values = {
        "a": [round(rng.uniform(0, 9e4), 2) for _ in range(400)], "b": [5.0] * 9 + [7.0], "c": [1.0], None: [rng.gauss(0, 1e6) for _ in range(101)],
        "d": [None, None], "e": [None, 2.0, 4.0], "f": [float("nan"), 1.0, 2.0], "g": [-3.0, -3.0, -3.0, -1.0],
    }
    df = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double").repartition(3)
    for spans in (4096, 1):
        got = {r.k: r["_q"] for r in ms.quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.75, 1.0], spans).collect()}
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")).collect()}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items() if v is not None}


def test_quantiles_of_one_value_and_of_infinities(spark):
    for own in ([4.0, 4.0], [float("-inf"), 0.0, 1.0, float("inf")], [-1e308, 1e308, 0.0]):
        df = spark.createDataFrame([("s", v) for v in own], "k string, v double")
        assert ms.quantiles(df, ["k"], "v", [1 / 3, 1.0]).first()["_q"][1] == max(own)
    assert ms.quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_summary_holds_no_group(spark, sf):
    from tessera.plans import catalog

    plan = catalog.QUERIES["grouped_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
