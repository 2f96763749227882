"""Values that lie exactly on a bound, and reading of large result rows."""

import functools
import json
import operator

from pyspark.sql import functions as F

from tessera.operators import instances as ins
from tessera.operators import raster as rs
from tessera.sources import results

#: Their mean is 0.05, but added up in this order it is 0.049999999999999996.
SHORT = [(v - 25) / 25 for v in (24, 15, 16, 40, 21, 25, 42, 27)]
PIXEL = "sample_id string, row long, col long, label long, v double, prob double"


def test_a_mean_on_its_bound_stays_in_any_order(spark):
    assert functools.reduce(operator.add, SHORT, 0.0) / 8 < 0.05
    base = spark.createDataFrame([], "sample_id string, row long, col long, label long")
    for order in (SHORT, SHORT[::-1], sorted(SHORT)):
        added = spark.createDataFrame([("s", 0, c, 1, 30.0, p) for c, p in enumerate(order)], PIXEL).coalesce(1)
        assert ins.add_measured(base, added, ["sample_id"], 0.3, 0.05, 24.0, 8, 35).count() == 8
        chosen = added.groupBy("sample_id", "label").agg(ins.steady(F.avg("prob")).alias("p")).where("p >= 0.05")
        assert ins.add_chosen(base, added, chosen, ["sample_id"]).count() == 8


def test_filters_keep_what_lies_on_a_bound(spark):
    pixels = spark.createDataFrame([("s", 0, 0, 1, 1.0, 0.15)], PIXEL)
    features = spark.createDataFrame([("s", 1, 0.14999999999999997, 1.0, 0.7500000000000001, 1.0)], "sample_id string, label long, mean_prob double, circularity double, eccentricity double, fill double")
    assert ins.selected(pixels, features, ["sample_id"], 0.15, 0.7, 0.75, 0.35).count() == 1


def test_quantiles_are_interpolated_as_in_the_sql(spark):
    import duckdb

    groups = {1: [0.2, 0.2, 0.32], 2: [0.2, 0.2, 0.56], 3: [0.4], 4: [0.08 * k for k in range(11)], 5: [-0.2, 0.04, 0.4, 0.44]}
    rows = [("s", 0, c, g, p) for g, values in groups.items() for c, p in enumerate(values)]
    got = rs.quantile_variants(spark.createDataFrame(rows, "sample_id string, row long, col long, label long, prob double"), ["sample_id"], [0.1, 0.25, 0.5])
    text = ", ".join(f"({g}, {c}, {p!r}::DOUBLE)" for _, _, c, g, p in rows)
    sql = " UNION ALL ".join(f"SELECT g, c, {q}::DOUBLE FROM (SELECT *, quantile_cont(p, {q}) OVER (PARTITION BY g) AS cut FROM t(g, c, p)) WHERE p >= cut" for q in (0.1, 0.25, 0.5))
    assert sorted((r.label, r.col, r.quantile) for r in got.collect()) == sorted(duckdb.sql(f"WITH t(g, c, p) AS (VALUES {text}) " + sql.replace("t(g, c, p)", "t")).fetchall())


def test_cells_of_a_row_do_not_carry_the_row(spark):
    cells = {f"iv_{k:06d}": f"{10 * k} 3" for k in range(500)}
    rows = spark.createDataFrame([("s", json.dumps(cells), "{}", "[]")], results.SCHEMA)
    listed = results.instances(rows)
    assert [(r.idx, r.cell_id, r.rle) for r in listed.orderBy("idx").collect()] == [(k, *x) for k, x in enumerate(cells.items())]
    assert "json_object_keys" not in listed._jdf.queryExecution().optimizedPlan().toString()  # a key a row, looked up in the whole object
