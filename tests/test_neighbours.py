"""Neighbours along lines, and variants counted instead of listed: same results, and pixels that move once."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import instances as ins
from tessera.operators import raster as rs
from tessera.plans import catalog

KEY, PLACE = ["sample_id"], ["sample_id", "row", "col"]
CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))


@pytest.fixture(scope="module")
def image():
    deal = random.Random(7)
    return {(s, r, c): deal.choice((0, 1, 1, 1, 2)) + 10 * (r // 6) * (c > 0) for s in "ab" for r in range(14) for c in range(12) if deal.random() < 0.9}


def _frame(spark, image, **more):
    deal = random.Random(3)
    rows = [(*at, label, float(deal.randrange(50)), deal.randrange(-20, 60) / 20, deal.choice((0, 1, 2)) + r // 7) for at, label in image.items() for r in (at[1],)]
    return spark.createDataFrame(rows, "sample_id string, row long, col long, label long, v double, prob double, gt long")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inner_ring_and_shrink_against_loops(spark, image):
    px = _frame(spark, image)
    beside = lambda at: [image.get((at[0], at[1] + r, at[2] + c)) for r, c in CROSS]
    rim = {at for at, label in image.items() if label > 0 and beside(at).count(label) < 4}
    kept = {at for at, label in image.items() if label > 0 and all(v in (None, label) for v in beside(at))}
    take = lambda df: {tuple(r) for r in df.select(*PLACE).collect()}
    assert rim and take(rs.inner_ring(px, KEY)) == rim
    assert kept and take(rs.shrink(px, None, KEY)) == kept == take(rs.shrink(px, px.drop("label"), KEY))


def test_a_pixel_moves_and_is_not_copied(spark, image):
    px = _frame(spark, image)
    ring, shrunk = _plan(rs.inner_ring(px, KEY)), _plan(rs.shrink(px, None, KEY))
    assert "Generate" not in ring + shrunk and "Join" not in ring + shrunk
    assert ring.count("Exchange") == 1 and shrunk.count("Exchange") == 2


def test_counted_variants_are_the_listed_ones(spark, image):
    px = _frame(spark, image).where("label > 0")
    truth = _frame(spark, image).where("gt > 0").select(*PLACE, F.col("gt").alias("label"))
    listed = ins.rim_variants(px, KEY)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(ins.rim_sizes(px, KEY)) == rows(listed.groupBy("variant", *KEY, "label").agg(F.count("*").alias("pixels")))
    ious = ins.variant_ious(listed, truth, KEY)
    assert rows(ins.rim_ious(px, truth, KEY)) == rows(ious)
    assert rows(ins.label_ious(px, truth, KEY)) == rows(ious.where("variant = 'base'").drop("variant"))
    choice = ious.where("label % 3 = 1").groupBy(*KEY, "label").agg(F.max_by("variant", F.struct("iou", "variant")).alias("variant"))
    assert rows(ins.rim_chosen(px, choice, KEY)) == rows(ins.chosen_variant(listed, choice, KEY).select(*PLACE, "label"))


@pytest.mark.parametrize("name, exchanges", [("rim_variants", 3), ("shape_vector", 3), ("variant_ious", 8), ("chosen_boundaries", 12), ("paired_boundaries", 8)])
def test_queries_list_no_pixel_once_a_variant(spark, sf, name, exchanges):
    assert _plan(catalog.QUERIES[name](spark, sf)).count("Exchange") <= exchanges
