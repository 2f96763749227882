"""Driver tables shaped as the engine's inputs, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g

#: The pose that projects in-vivo points in the queries.
POSE = (0.955, -0.168, 12.0, 0.168, 0.955, -7.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample(number) -> tuple:
    return F.concat(F.lit("m"), (number % 3).cast("string")).alias("subject"), F.concat(F.lit("m"), (number % 3).cast("string"), F.lit("__r"), number.cast("string")).alias("sample_id")


def points(spark: SparkSession, sf_dir: str, modality: str) -> DataFrame:
    """Vectors of even id are in-vivo cells, the others ex-vivo cells."""
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == (0 if modality == "iv" else 1))
    return rows.select(
        *_sample(F.col("label")), F.col("vec_id").alias("idx"), (400 * e(0)).alias("x"), (400 * e(1)).alias("y"), e(2).alias("brightness"),
        (100 + F.floor(200 * e(3))).alias("area"), e(4).alias("mean"), e(5).alias("contrast"), (0.5 + 2 * e(6)).alias("prob"),
    )


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv, m = points(spark, sf_dir, "iv"), g.pose(POSE)
    return iv.withColumns({"x": g.move_x(m, F.col("x"), F.col("y")), "y": g.move_y(m, F.col("x"), F.col("y"))})


POINTS_SQL = """
pts AS (
  SELECT 'm' || (label % 3) AS subject, 'm' || (label % 3) || '__r' || label AS sample_id, vec_id AS idx, vec_id % 2 AS side,
         400 * embedding[1]::DOUBLE AS x, 400 * embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS brightness,
         (100 + floor(200 * embedding[4]::DOUBLE))::BIGINT AS area, embedding[5]::DOUBLE AS mean, embedding[6]::DOUBLE AS contrast,
         0.5::DOUBLE + 2 * embedding[7]::DOUBLE AS prob
  FROM embeddings
), iv AS (SELECT * FROM pts WHERE side = 0), ex AS (SELECT * FROM pts WHERE side = 1),
pj AS (
  SELECT * REPLACE (0.955::DOUBLE * x + -0.168::DOUBLE * y + 12.0::DOUBLE AS x, 0.168::DOUBLE * x + 0.955::DOUBLE * y + -7.0::DOUBLE AS y) FROM iv
)"""

#: All distances between projected in-vivo and ex-vivo points of a sample.
NEAR_SQL = POINTS_SQL + """,
near AS (
  SELECT a.sample_id, a.idx AS i, b.idx AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM pj a JOIN ex b USING (sample_id)
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels: 500 orders are an image of seven columns; pred and gt labels from quantity."""
    image = F.floor(F.col("l_orderkey") / 500)
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("v"))
    row = F.col("l_orderkey") % 500
    return line.select(
        *_sample(image), row.alias("row"), F.col("l_linenumber").cast("long").alias("col"), "v", ((F.col("v") - 25) / 25).alias("prob"),
        F.when(F.col("v") > 10, F.floor(row / 6) + 1).otherwise(0).cast("long").alias("pred"),
        F.when(F.col("v") > 13, F.floor((row + image % 2) / 6) + 1).otherwise(0).cast("long").alias("gt"),
    )


PIXELS_SQL = """
px AS (
  SELECT 'm' || (image % 3) AS subject, 'm' || (image % 3) || '__r' || image AS sample_id, k % 500 AS row, l AS col, v, (v - 25) / 25 AS prob,
         CASE WHEN v > 10 THEN (k % 500) // 6 + 1 ELSE 0 END::BIGINT AS pred, CASE WHEN v > 13 THEN (k % 500 + image % 2) // 6 + 1 ELSE 0 END::BIGINT AS gt
  FROM (SELECT l_orderkey AS k, l_linenumber::BIGINT AS l, max(l_quantity) AS v, l_orderkey // 500 AS image FROM lineitem GROUP BY ALL)
)"""

INTER_SQL = PIXELS_SQL + """,
inter AS (SELECT sample_id, pred, gt, count(*) AS inter FROM px WHERE pred > 0 AND gt > 0 GROUP BY ALL),
ap AS (SELECT sample_id, pred, count(*) AS area_pred FROM px WHERE pred > 0 GROUP BY ALL),
ag AS (SELECT sample_id, gt, count(*) AS area_gt FROM px WHERE gt > 0 GROUP BY ALL),
iou AS (SELECT *, inter::DOUBLE / (area_pred + area_gt - inter) AS iou FROM inter JOIN ap USING (sample_id, pred) JOIN ag USING (sample_id, gt)),
smp AS (SELECT DISTINCT sample_id, subject FROM px),
score AS (
  SELECT s.subject, s.sample_id, coalesce(tp, 0)::BIGINT AS tp, coalesce(np, 0)::BIGINT AS np, coalesce(ng, 0)::BIGINT AS ng, coalesce(t, 0) AS t, coalesce(near_miss, 0)::BIGINT AS near_miss,
         CASE WHEN coalesce(np, 0) = 0 AND coalesce(ng, 0) = 0 THEN 1.0::DOUBLE WHEN coalesce(np, 0) = 0 OR coalesce(ng, 0) = 0 THEN 0 ELSE 2 * coalesce(t, 0) / (np + ng) END AS pq
  FROM smp s LEFT JOIN (SELECT sample_id, count(*) FILTER (iou > 0.75) AS tp, coalesce(sum(iou) FILTER (iou > 0.75), 0) AS t, count(*) FILTER (iou >= 0.5 AND iou <= 0.75) AS near_miss FROM iou GROUP BY ALL) USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS np FROM ap GROUP BY ALL) USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS ng FROM ag GROUP BY ALL) USING (sample_id)
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a pose candidate of its label's sample."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        *_sample(F.col("label")), F.col("vec_id").alias("cand_idx"), (20 + 40 * e(0)).alias("score"), (8 * e(1)).alias("z"), (20 * e(2)).alias("angle"),
        (300 + 400 * e(3)).alias("land_x"), (300 + 400 * e(4)).alias("land_y"), e(5).alias("image"),
        F.struct((1 + e(6)).alias("a"), e(7).alias("b"), (50 * e(8)).alias("tx"), e(9).alias("c"), (1 + e(10)).alias("d"), (50 * e(11)).alias("ty")).alias("pose"),
        (10.0 * (F.col("label") % 7)).alias("ox"), (15.0 * (F.col("label") % 5)).alias("oy"),
    )


CANDIDATES_SQL = """
cand AS (
  SELECT 'm' || (label % 3) AS subject, 'm' || (label % 3) || '__r' || label AS sample_id, vec_id AS cand_idx, 20 + 40 * embedding[1]::DOUBLE AS score,
         8 * embedding[2]::DOUBLE AS z, 20 * embedding[3]::DOUBLE AS angle, 300 + 400 * embedding[4]::DOUBLE AS land_x, 300 + 400 * embedding[5]::DOUBLE AS land_y,
         embedding[6]::DOUBLE AS image, 1 + embedding[7]::DOUBLE AS a, embedding[8]::DOUBLE AS b, 50 * embedding[9]::DOUBLE AS tx, embedding[10]::DOUBLE AS c,
         1 + embedding[11]::DOUBLE AS d, 50 * embedding[12]::DOUBLE AS ty, (10.0 * (label % 7))::DOUBLE AS ox, (15.0 * (label % 5))::DOUBLE AS oy
  FROM embeddings
)"""


def runs(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Events as runs of instances."""
    shift, modulo, groups = ((0, 9, 50), (2, 7, 40))[side]
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sample_id"), (F.col("user_id") % groups + 1).alias("label"), (4 * F.col("event_id") + shift).alias("start"), (1 + side + F.col("user_id") % modulo).alias("len")
    )


RUNS_SQL = """
ra AS (SELECT event_type AS sample_id, user_id % 50 + 1 AS label, 4 * event_id AS s, 1 + user_id % 9 AS len FROM events),
rb AS (SELECT event_type AS sample_id, user_id % 40 + 1 AS label, 4 * event_id + 2 AS s, 2 + user_id % 7 AS len FROM events)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as pair candidates: region, ends, probability, truth."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(*_sample(d % 30), d.alias("k"), (d * 7 % 41).alias("i"), (d * 11 % 43).alias("j"), ((d * 37 % 1000) / 1000).alias("prob"), (F.col("quality") == 1).alias("y"))


PAIRS_SQL = """
prs AS (
  SELECT 'm' || (doc_id % 30 % 3) AS subject, 'm' || (doc_id % 30 % 3) || '__r' || (doc_id % 30) AS sample_id, doc_id AS k, doc_id * 7 % 41 AS i, doc_id * 11 % 43 AS j,
         (doc_id * 37 % 1000)::DOUBLE / 1000 AS prob, quality = 1 AS y
  FROM labels
)"""


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as pair candidates of the regions of ``gate_regions``, up to four a region."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(_sample(F.floor(d / 4))[1], ((d * 37 % 1000) / 1000).alias("prob"), (F.col("quality") == 1).alias("y"))


REGION_PAIRS_SQL = """
prs AS (
  SELECT 'm' || (doc_id // 4 % 3) || '__r' || (doc_id // 4) AS sample_id, doc_id AS k, (doc_id * 37 % 1000)::DOUBLE / 1000 AS prob, quality = 1 AS y FROM labels
)"""


def gate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers as regions with a verifier probability and gates."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(*_sample(c), ((c * 29 % 100) / 100).alias("prob"), (c % 4 == 0).alias("v10"), (c % 9 != 1).alias("registered"), (c % 7 != 2).alias("has_gt"), (c % 5 != 3).alias("correct"))


GATES_SQL = """
gates AS (
  SELECT 'm' || (c_custkey % 3) AS subject, 'm' || (c_custkey % 3) || '__r' || c_custkey AS sample_id, (c_custkey * 29 % 100)::DOUBLE / 100 AS prob,
         c_custkey % 4 = 0 AS v10, c_custkey % 9 <> 1 AS registered, c_custkey % 7 <> 2 AS has_gt, c_custkey % 5 <> 3 AS correct
  FROM customer
)"""


def result_pairs(spark: SparkSession, sf_dir: str, modulo: int = 97) -> DataFrame:
    """Orders as predicted cell pairs."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("sample_id"), (F.col("o_orderkey") % modulo).cast("string").alias("iv_id"), (F.col("o_custkey") % 89).cast("string").alias("ex_id"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six decimals (and no negative zero), so that sums of different order agree."""
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})
