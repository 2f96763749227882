"""Queries on point clouds and pose candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import candidates as cd
from tessera.operators import kernels
from tessera.operators import matching as mt
from tessera.operators import points as pt
from tessera.plans import adapters as ad
from tessera.plans.adapters import CANDIDATES_SQL, NEAR_SQL, POINTS_SQL, rounded
from tessera.plans.stages import ensure_checkpoint_dir

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {POINTS_SQL} SELECT sample_id, idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM pj")
def affine_project(spark, sf_dir):
    return rounded(ad.projected(spark, sf_dir).select("sample_id", "idx", "x", "y"), "x", "y")


_MUTUAL = NEAR_SQL + """,
mut AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY d, j) AS ri, row_number() OVER (PARTITION BY sample_id, j ORDER BY d, i) AS rj FROM near)
  WHERE ri = 1 AND rj = 1
)"""
_NEAREST = """,
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY d, j) AS r FROM near WHERE d < 8) WHERE r = 1),
np AS (SELECT sample_id, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, j ORDER BY d, i) AS q FROM n1) WHERE q = 1)"""


@query(f"WITH {NEAR_SQL}{_NEAREST} SELECT sample_id, i, j, round(d, 6) AS d FROM np")
def nearest_pairs(spark, sf_dir):
    return rounded(pt.nearest_pairs(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex"), 8.0).select("sample_id", "i", "j", "d"), "d")


@query(f"WITH {_MUTUAL} SELECT sample_id, i, j, round(d, 6) AS d FROM mut WHERE d < 10")
def mutual_pairs(spark, sf_dir):
    return rounded(pt.mutual_pairs(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex"), 10.0), "d")


@query(f"WITH {_MUTUAL} SELECT sample_id, count(*) AS n_pairs, round(sum(exp(-d * d / 12.5::DOUBLE)), 6) AS soft FROM mut WHERE d < 30 GROUP BY ALL")
def soft_score(spark, sf_dir):
    return rounded(pt.soft_score(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex")), "soft")


@query(f"WITH {NEAR_SQL}{_NEAREST} SELECT sample_id, round(sum(1 + greatest(0, 1 - d / 8)), 6) AS score FROM np GROUP BY ALL")
def refine_score(spark, sf_dir):
    return rounded(pt.refine_score(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex")), "score")


@query(f"""WITH {_MUTUAL} SELECT sample_id, round(sum(exp(-d * d / 4.5::DOUBLE)), 6) AS soft_0, round(sum(exp(-d * d / 12.5::DOUBLE)), 6) AS soft_1, round(sum(exp(-d * d / 32.0::DOUBLE)), 6) AS soft_2,
  count(*) FILTER (d < 3) AS close_0, count(*) FILTER (d < 5) AS close_1, count(*) FILTER (d < 8) AS close_2 FROM mut WHERE d < 48 GROUP BY ALL""")
def pose_objectives(spark, sf_dir):
    return rounded(pt.objectives(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex")), "soft_0", "soft_1", "soft_2")


@query(f"""WITH {NEAR_SQL}{_NEAREST}, sec AS (SELECT sample_id, i, d AS second FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY d, j) AS r FROM near) WHERE r = 2)
SELECT sample_id, i, j, round(d, 6) AS d FROM np LEFT JOIN sec USING (sample_id, i) WHERE second IS NULL OR second >= 1.5 * greatest(d, 0.5)""")
def ratio_test(spark, sf_dir):
    return rounded(pt.ratio_test(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex"), 8.0, 1.5), "d")


@query(f"WITH {POINTS_SQL} SELECT sample_id, idx FROM (SELECT *, count(*) FILTER (brightness >= 0.2) OVER (PARTITION BY sample_id) AS n FROM ex) WHERE brightness >= 0.2 OR n < 3")
def brightness_fallback(spark, sf_dir):
    return pt.bright_or_all(ad.points(spark, sf_dir, "ex"), 0.2).select("sample_id", "idx")


@query(f"WITH {NEAR_SQL} SELECT sample_id, i, j, round(d, 6) AS d FROM near WHERE d <= 12")
def radius_join(spark, sf_dir):
    return rounded(pt.within(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex"), 12.0), "d")


@query(f"WITH {NEAR_SQL} SELECT sample_id, idx FROM pj WHERE EXISTS (SELECT 1 FROM near n WHERE n.sample_id = pj.sample_id AND n.i = pj.idx AND d <= 6)")
def pseudo_label_retain(spark, sf_dir):
    return pt.retained(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex"), 6.0).select("sample_id", "idx")


@query(f"WITH {NEAR_SQL} SELECT sample_id, idx FROM ex WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.sample_id = ex.sample_id AND n.j = ex.idx AND d <= 6)")
def pseudo_label_seed(spark, sf_dir):
    return pt.seeds(ad.points(spark, sf_dir, "ex"), ad.projected(spark, sf_dir), 6.0).select("sample_id", "idx")


@query(f"""WITH {POINTS_SQL}, s AS (SELECT *, 's' || (idx % 5) AS source FROM pts)
SELECT a.sample_id, a.idx, a.source, count(DISTINCT b.source) AS votes FROM s a JOIN s b ON a.sample_id = b.sample_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4 GROUP BY ALL""")
def spatial_support(spark, sf_dir):
    pts = ad.points(spark, sf_dir, "iv").unionByName(ad.points(spark, sf_dir, "ex"))
    return pt.support(pts.withColumn("source", F.concat(F.lit("s"), (F.col("idx") % 5).cast("string"))), 4.0)


_JITTER = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate([(0.0, 0.0), *pt.jitter_lattice()]))


@query(f"""WITH {POINTS_SQL}, ev AS (SELECT DISTINCT sample_id, (round_even(y, 0) + dr)::BIGINT AS row, (round_even(x, 0) + dc)::BIGINT AS col FROM ex, range(-2, 3) a(dr), range(-2, 3) b(dc)),
j(k, dx, dy) AS (VALUES {_JITTER}),
m AS (SELECT sample_id, k, round_even(x + dx::DOUBLE, 0)::BIGINT AS col, round_even(y + dy::DOUBLE, 0)::BIGINT AS row FROM pj, j),
r AS (SELECT m.sample_id, k, avg(CASE WHEN ev.row IS NULL THEN 0.0 ELSE 1.0 END) AS rate, count(*) AS n FROM m LEFT JOIN ev USING (sample_id, row, col) WHERE m.row >= 0 AND m.row < 150 AND m.col >= 0 AND m.col < 150 GROUP BY ALL HAVING count(*) >= 3),
z AS (SELECT sample_id, max(rate) FILTER (k = 0) AS own, avg(rate) FILTER (k > 0) AS mu, stddev_pop(rate) FILTER (k > 0) AS sd, count(*) FILTER (k > 0) AS nulls FROM r GROUP BY ALL)
SELECT s.sample_id, round(CASE WHEN own IS NOT NULL AND nulls >= 5 THEN (own - mu) / (sd + 0.001::DOUBLE) ELSE -9 END, 6) AS z FROM (SELECT DISTINCT sample_id FROM pj) s LEFT JOIN z USING (sample_id)""")
def evidence_z(spark, sf_dir):
    from tessera.operators import raster

    ex = ad.points(spark, sf_dir, "ex").select("sample_id", F.rint("y").cast("long").alias("row"), F.rint("x").cast("long").alias("col"))
    iv = ad.projected(spark, sf_dir)
    sizes = iv.select("sample_id").distinct().select("sample_id", F.lit(150).alias("h"), F.lit(150).alias("w"))
    return rounded(pt.evidence_z(iv, raster.dilate(ex, ["sample_id"]), sizes, least_points=3), "z")


@query(f"WITH {POINTS_SQL} SELECT sample_id, idx, (row_number() OVER (PARTITION BY sample_id ORDER BY contrast, idx) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY sample_id) - 1, 1) AS rank FROM ex")
def ordinal_rank(spark, sf_dir):
    return pt.ordinal_rank(ad.points(spark, sf_dir, "ex"), ["sample_id"], "contrast", "idx", "rank").select("sample_id", "idx", "rank")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY ALL)
SELECT event_id, round(least(greatest((value - lo) / greatest(hi - lo, 1e-6::DOUBLE), 0), 1), 6) AS norm FROM events JOIN q USING (event_type)""")
def percentile_normalise(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(pt.percentile_normalise(events, ["event_type"], "value", 0.01, 0.99).select("event_id", "norm"), "norm")


_DESCRIBE = """, dd AS (
  SELECT a.sample_id, a.side, a.idx AS i, least(floor((ln(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) - ln(2.0::DOUBLE)) / ((ln(200.0::DOUBLE) - ln(2.0::DOUBLE)) / 8)), 7)::INT AS bin
  FROM pts a JOIN pts b ON a.sample_id = b.sample_id AND a.side = b.side AND a.idx <> b.idx WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN 2 AND 200
), h AS (SELECT sample_id, side, i, bin, count(*) AS n FROM dd GROUP BY ALL), w AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY sample_id, side, i)) AS w FROM h)"""


@query(f"WITH {POINTS_SQL}{_DESCRIBE} SELECT a.sample_id, a.i, b.i AS j, round(sum(a.w * b.w), 6) AS cosine FROM w a JOIN w b ON a.side = 0 AND b.side = 1 AND a.sample_id = b.sample_id AND a.bin = b.bin GROUP BY ALL")
def descriptor_similarity(spark, sf_dir):
    return rounded(pt.similarity(pt.descriptors(ad.points(spark, sf_dir, "iv")), pt.descriptors(ad.points(spark, sf_dir, "ex"))), "cosine")


_PAIR_FEATURES = ["d", "iv_area", "iv_mean", "iv_contrast", "iv_rank", "iv_n", "ex_area", "ex_mean", "ex_contrast", "ex_rank", "ex_n", "close5"]


@query(f"""WITH {_MUTUAL}, f AS (SELECT *, (row_number() OVER (PARTITION BY side, sample_id ORDER BY contrast, idx) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY side, sample_id) - 1, 1) AS rank, count(*) OVER (PARTITION BY side, sample_id) AS n FROM pts),
m AS (SELECT *, count(*) FILTER (d < 5) OVER (PARTITION BY sample_id) AS close5 FROM mut WHERE d < 10)
SELECT m.sample_id, m.i, m.j, round(d, 6) AS d, a.area AS iv_area, round(a.mean, 6) + 0.0 AS iv_mean, round(a.contrast, 6) + 0.0 AS iv_contrast, round(a.rank, 6) AS iv_rank, a.n AS iv_n,
       b.area AS ex_area, round(b.mean, 6) + 0.0 AS ex_mean, round(b.contrast, 6) + 0.0 AS ex_contrast, round(b.rank, 6) AS ex_rank, b.n AS ex_n, close5
FROM m JOIN f a ON a.side = 0 AND a.idx = m.i JOIN f b ON b.side = 1 AND b.idx = m.j""")
def pair_features(spark, sf_dir):
    iv, ex = ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex")
    pairs = pt.mutual_pairs(ad.projected(spark, sf_dir), ex, 10.0)
    out = mt.candidate_features(iv, ex, pairs).select("sample_id", "i", "j", *_PAIR_FEATURES)
    return rounded(out, "d", "iv_mean", "iv_contrast", "iv_rank", "ex_mean", "ex_contrast", "ex_rank")


# ---------------------------------------------------------------- candidates

_ANGLES, _SCALES = (-6.0, 6.0, 6.0), (0.95, 1.05, 0.05)
_GRID = """
gr AS (
  SELECT (ia * 3 + js)::BIGINT AS pose_id, angle, scale, scale * cos(radians(angle)) AS a, -scale * sin(radians(angle)) AS b, scale * sin(radians(angle)) AS c, scale * cos(radians(angle)) AS d
  FROM (SELECT i AS ia, -6.0::DOUBLE + i * 6.0::DOUBLE AS angle FROM range(3) t(i)), (SELECT i AS js, 0.95::DOUBLE + i * 0.05::DOUBLE AS scale FROM range(3) t(i))
)"""
_DIFF = f"WITH {POINTS_SQL}, {_GRID}" + """,
df AS (SELECT iv.sample_id, pose_id, ex.x - (gr.a * iv.x + gr.b * iv.y) AS dx, ex.y - (gr.c * iv.x + gr.d * iv.y) AS dy FROM iv CROSS JOIN gr JOIN ex USING (sample_id)),
vt AS (SELECT sample_id, pose_id, floor((dx + 2500) / 12)::BIGINT AS bx, floor((dy + 2500) / 12)::BIGINT AS "by", count(*) AS votes FROM df GROUP BY ALL)"""


def _grid(spark):
    return cd.pose_grid(spark, _ANGLES, _SCALES)


@query("""SELECT ((ia * 29 + js) * 17 + k)::BIGINT AS pose_id, round(-35 + 0.5::DOUBLE * ia, 6) + 0.0 AS angle, round(0.85::DOUBLE + 0.01::DOUBLE * js, 6) AS scale, k AS kind
FROM range(141) a(ia), range(29) b(js), range(17) c(k)""")
def pose_grid(spark, sf_dir):
    grid = cd.pose_grid(spark, stretches=cd.STRETCHES)
    return rounded(grid.select("pose_id", "angle", "scale", (F.col("pose_id") % 17).alias("kind")), "angle", "scale")


@query(_DIFF + """ SELECT sample_id, pose_id, bx, "by", votes FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pose_id ORDER BY votes DESC, "by", bx) AS r FROM vt) WHERE r <= 3""")
def hough_votes(spark, sf_dir):
    return cd.top_bins(cd.pair_votes(ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), _grid(spark), 12.0), 3).select("sample_id", "pose_id", "bx", "by", "votes")


_BOX = _DIFF + """,
bx AS (
  SELECT v.sample_id, v.pose_id, v.bx, v."by", sum(w.votes)::BIGINT AS box FROM vt v JOIN vt w ON v.sample_id = w.sample_id AND v.pose_id = w.pose_id AND w.bx IN (v.bx, v.bx + 1) AND w."by" IN (v."by", v."by" + 1) GROUP BY ALL
)"""


@query(_BOX + """ SELECT sample_id, pose_id, bx, "by", box FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pose_id ORDER BY box DESC, "by", bx) AS r FROM bx) WHERE r <= 2""")
def hough_box_votes(spark, sf_dir):
    return cd.top_bins(cd.box_votes(cd.pair_votes(ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), _grid(spark), 12.0)), 2, "box").select("sample_id", "pose_id", "bx", "by", "box")


@query(_DIFF + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pose_id ORDER BY votes DESC, "by", bx) AS r FROM vt) WHERE r <= 1)
SELECT t.sample_id, t.pose_id, count(*) AS n, round(quantile_cont(dx, 0.5), 6) + 0.0 AS tx, round(quantile_cont(dy, 0.5), 6) + 0.0 AS ty
FROM top t JOIN df ON df.sample_id = t.sample_id AND df.pose_id = t.pose_id AND abs(floor((dx + 2500) / 12) - bx) <= 1 AND abs(floor((dy + 2500) / 12) - "by") <= 1 GROUP BY t.sample_id, t.pose_id, bx, "by" HAVING count(*) >= 3""")
def hough_shift(spark, sf_dir):
    iv, ex, grid = ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), _grid(spark)
    ensure_checkpoint_dir(spark)
    peaks = cd.top_bins(cd.pair_votes(iv, ex, grid, 12.0), 1).checkpoint()  # one a pose
    return rounded(cd.peak_shift(iv, ex, grid, peaks, 12.0).select("sample_id", "pose_id", "n", "tx", "ty"), "tx", "ty")


@query(_DIFF + """, lw AS (
  SELECT df.sample_id, pose_id, dx, dy FROM df JOIN gr USING (pose_id) WHERE abs(angle - 2) <= 5 AND (dx + a * 290 + b * 280 - 310) * (dx + a * 290 + b * 280 - 310) + (dy + c * 290 + d * 280 - 290) * (dy + c * 290 + d * 280 - 290) <= 3600
) SELECT sample_id, pose_id, floor((dx + 2500) / 5)::BIGINT AS bx, floor((dy + 2500) / 5)::BIGINT AS "by", count(*) AS votes FROM lw GROUP BY ALL""")
def window_votes(spark, sf_dir):
    iv, grid = ad.points(spark, sf_dir, "iv"), _grid(spark)
    samples = iv.select("sample_id").distinct()
    modes = samples.select("sample_id", F.lit(2.0).alias("angle"), F.lit(310.0).alias("land_x"), F.lit(290.0).alias("land_y"))
    offsets = samples.select("sample_id", F.lit(10.0).alias("ox"), F.lit(20.0).alias("oy"))
    near = cd.poses_near(grid, modes, 5.0)
    diffs = cd.window_differences(iv, ad.points(spark, sf_dir, "ex"), near, modes, offsets, 60.0)
    return cd.votes(cd.in_window(diffs, near, modes, offsets, 60.0), 5.0)


@query(f"""WITH {POINTS_SQL}, c AS (
  SELECT sample_id, (floor(y / 20) + dr)::BIGINT AS row, (floor(x / 20) + dc)::BIGINT AS col,
         (CASE WHEN dc = 1 THEN x / 20 - floor(x / 20) ELSE 1 - (x / 20 - floor(x / 20)) END) * (CASE WHEN dr = 1 THEN y / 20 - floor(y / 20) ELSE 1 - (y / 20 - floor(y / 20)) END) AS w
  FROM ex, range(2) a(dr), range(2) b(dc)
) SELECT sample_id, row, col, round(sum(w), 6) AS w FROM c WHERE w > 0 GROUP BY ALL""")
def splat_grid(spark, sf_dir):
    return rounded(cd.splat(ad.points(spark, sf_dir, "ex"), 20.0), "w")


_CORR = _DIFF + """,
sh AS (SELECT (10 * i)::DOUBLE AS tx, (10 * j)::DOUBLE AS ty FROM range(-2, 3) a(i), range(-2, 3) b(j)),
cr AS (SELECT sample_id, pose_id, tx, ty, sum(exp(-((dx - tx) * (dx - tx) + (dy - ty) * (dy - ty)) / 50.0::DOUBLE)) AS score FROM df, sh WHERE (dx - tx) * (dx - tx) + (dy - ty) * (dy - ty) <= 400 GROUP BY ALL)"""


def _correlation(spark, sf_dir):
    steps = spark.range(-2, 3)
    shifts = steps.select((10.0 * F.col("id")).alias("tx")).crossJoin(steps.select((10.0 * F.col("id")).alias("ty")))
    return cd.correlate(ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), _grid(spark), shifts, 5.0)


@query(_CORR + " SELECT sample_id, pose_id, tx, ty, round(score, 6) AS score FROM cr")
def brute_force_correlation(spark, sf_dir):
    return rounded(_correlation(spark, sf_dir), "score")


@query(_CORR + """ SELECT sample_id, pose_id, tx, ty, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, pose_id ORDER BY score DESC, ty, tx) AS r FROM cr a
  WHERE NOT EXISTS (SELECT 1 FROM cr b WHERE a.sample_id = b.sample_id AND a.pose_id = b.pose_id AND abs(a.tx - b.tx) <= 10 AND abs(a.ty - b.ty) <= 10 AND (b.tx <> a.tx OR b.ty <> a.ty)
                    AND (b.score > a.score OR (b.score = a.score AND (b.ty < a.ty OR (b.ty = a.ty AND b.tx < a.tx)))))
) WHERE r <= 4""")
def local_maxima(spark, sf_dir):
    return rounded(cd.local_maxima(_correlation(spark, sf_dir), 10.0, 4).select("sample_id", "pose_id", "tx", "ty", "score"), "score")


@query(f"""WITH {CANDIDATES_SQL}, q AS (SELECT *, a * a + b * b + c * c + d * d AS q, a * d - b * c AS det FROM cand)
SELECT sample_id, cand_idx, round(degrees(atan2(c, a)), 6) + 0.0 AS angle, round(sqrt(abs(det)), 6) AS scale, round(sqrt((q + sqrt(greatest(q * q - 4 * det * det, 0))) / 2) / sqrt((q - sqrt(greatest(q * q - 4 * det * det, 0))) / 2) - 1, 4) AS anisotropy,
       round(a * (300 - ox) + b * (300 - oy) + tx, 6) AS land_x, round(c * (300 - ox) + d * (300 - oy) + ty, 6) AS land_y FROM q""")
def pose_features(spark, sf_dir):
    out = cd.describe(ad.candidates(spark, sf_dir)).withColumn("anisotropy", F.round("anisotropy", 4))
    return rounded(out.select("sample_id", "cand_idx", "angle", "scale", "anisotropy", "land_x", "land_y"), "angle", "scale", "land_x", "land_y")


@query(f"""WITH {CANDIDATES_SQL}, t AS (SELECT sample_id, cand_idx % 4 AS g, land_x - 300 AS x, land_y - 300 AS y FROM cand), p AS (SELECT * FROM cand),
e AS (SELECT p.sample_id, p.cand_idx, quantile_cont(sqrt((a * x + b * y + tx - (x + 1)) * (a * x + b * y + tx - (x + 1)) + (c * x + d * y + ty - (y - 1)) * (c * x + d * y + ty - (y - 1))), 0.5) AS err FROM p JOIN t USING (sample_id) GROUP BY ALL)
SELECT sample_id, cand_idx, round(err, 6) AS err, err < 5 AS correct, min(cand_idx) FILTER (err < 5) OVER (PARTITION BY sample_id) AS first_correct FROM e""")
def pose_errors(spark, sf_dir):
    c = ad.candidates(spark, sf_dir)
    x, y = F.col("land_x") - 300, F.col("land_y") - 300
    truth = c.select("sample_id", x.alias("x"), y.alias("y"), (x + 1).alias("gx"), (y - 1).alias("gy"))
    return rounded(cd.median_errors(c.select("sample_id", "cand_idx", "pose"), truth), "err")


# ---------------------------------------------------------------- NumPy kernels (no SQL form)


@query()
def pose_refine(spark, sf_dir):
    return rounded(kernels.refine_samples(ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), ad.POSE), "a", "b", "tx", "c", "d", "ty", "score")


@query()
def fft_scan(spark, sf_dir):
    return kernels.scan_samples(ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), kernels.SCAN_ANGLES)


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_idx) AS r FROM cand),
w AS (SELECT DISTINCT sample_id, 0::BIGINT AS r, []::STRUCT(a DOUBLE, x DOUBLE, y DOUBLE)[] AS found, false AS taken FROM o
  UNION ALL SELECT sample_id, r, CASE WHEN free THEN list_append(found, own) ELSE found END, free
  FROM (SELECT o.sample_id, o.r, found, {{'a': o.angle, 'x': o.land_x, 'y': o.land_y}} AS own, len(found) < 30
               AND len(list_filter(found, lambda f: abs(f.a - o.angle) <= 3 AND sqrt((f.x - o.land_x) * (f.x - o.land_x) + (f.y - o.land_y) * (f.y - o.land_y)) <= 20)) = 0 AS free
        FROM w JOIN o ON o.sample_id = w.sample_id AND o.r = w.r + 1))
SELECT sample_id, cand_idx, score, row_number() OVER (PARTITION BY sample_id ORDER BY r)::INT AS place FROM o JOIN w USING (sample_id, r) WHERE taken""")
def nms_dedup(spark, sf_dir):
    return kernels.separate(ad.candidates(spark, sf_dir), 30)


@query()
def hungarian(spark, sf_dir):
    return rounded(kernels.hungarian_points(ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex"), 12.0), "d")


@query()
def segment_images(spark, sf_dir):
    pixels = ad.pixels(spark, sf_dir).select("sample_id", "row", "col", "v")
    return kernels.label_images(pixels, kernels.segment, threshold=0.05, least=3, most=40)
