"""Queries on label maps, run-length masks and small rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rle
from tessera.operators import labels as lb
from tessera.operators import metrics as ms
from tessera.operators import points as pt
from tessera.operators import raster as rs
from tessera.plans import adapters as ad
from tessera.plans.adapters import INTER_SQL, PIXELS_SQL, RUNS_SQL, rounded

QUERIES, ORACLE_SQL = {}, {}
KEY = ["sample_id"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _labelled(spark, sf_dir, label: str = "pred"):
    return ad.pixels(spark, sf_dir).withColumnRenamed(label, "label")


@query(f"WITH {PIXELS_SQL} SELECT sample_id, pred AS label, round(avg(col), 6) AS x, round(avg(row), 6) AS y, count(*) AS area FROM px WHERE pred > 0 GROUP BY ALL")
def label_centroids(spark, sf_dir):
    return rounded(pt.centroids(_labelled(spark, sf_dir), KEY), "x", "y")


@query(f"""WITH {PIXELS_SQL}, r AS (SELECT sample_id, gt AS label, avg(col) AS x, avg(row) AS y, count(*) AS area FROM px WHERE gt > 0 AND gt % 5 <> 2 GROUP BY ALL),
e AS (SELECT sample_id, unnest(range(1, max(label) + 1)) AS label FROM r GROUP BY sample_id)
SELECT sample_id, label, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y, coalesce(area, 0)::BIGINT AS area FROM e LEFT JOIN r USING (sample_id, label)""")
def ghost_centroids(spark, sf_dir):
    return rounded(pt.centroids(_labelled(spark, sf_dir, "gt").where("label % 5 <> 2"), KEY, ghosts=True), "x", "y")


@query(f"WITH {PIXELS_SQL} SELECT sample_id, pred AS label, count(*) AS area, round(avg(v), 6) AS mean_v, round(avg(prob), 6) + 0.0 AS mean_prob FROM px WHERE pred > 0 GROUP BY ALL")
def label_stats(spark, sf_dir):
    return rounded(pt.label_stats(_labelled(spark, sf_dir), KEY, ["v", "prob"]), "mean_v", "mean_prob")


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT sample_id, pred AS label, count(*) AS area, count(*)::DOUBLE / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)) AS fill, max(v) AS core,
  var_pop(row) + 1.0::DOUBLE / 12 AS r, var_pop(col) + 1.0::DOUBLE / 12 AS c, covar_pop(row, col) AS rc FROM px WHERE pred > 0 GROUP BY ALL),
s AS (SELECT *, sqrt((r - c) * (r - c) + 4 * rc * rc) AS root FROM m)
SELECT sample_id, label, area, round(fill, 6) AS fill, core, round(sqrt(greatest(0, 1 - (r + c - root) / (r + c + root))), 6) AS eccentricity FROM s""")
def shape_features(spark, sf_dir):
    return rounded(pt.shape_features(_labelled(spark, sf_dir), KEY), "fill", "eccentricity")


@query(f"WITH {PIXELS_SQL}, k AS (SELECT sample_id, gt, row_number() OVER (PARTITION BY sample_id ORDER BY gt) AS dense FROM (SELECT DISTINCT sample_id, gt FROM px WHERE gt > 0 AND gt % 3 <> 1)) SELECT px.sample_id, row, col, coalesce(dense, 0)::INT AS dense FROM px LEFT JOIN k USING (sample_id, gt) WHERE gt % 3 <> 1")
def relabel_dense(spark, sf_dir):
    return lb.relabel(_labelled(spark, sf_dir, "gt").where("label % 3 <> 1"), KEY).select("sample_id", "row", "col", "dense")


@query(f"WITH {PIXELS_SQL} SELECT sample_id, row, col, pred AS label FROM px WHERE pred > 0 AND (sample_id, pred) IN (SELECT (sample_id, pred) FROM px WHERE pred > 0 GROUP BY sample_id, pred HAVING count(*) BETWEEN 15 AND 22)")
def size_gate(spark, sf_dir):
    return lb.size_gate(_labelled(spark, sf_dir), KEY, 15, 22).where("label > 0").select("sample_id", "row", "col", "label")


@query(f"WITH {INTER_SQL} SELECT * FROM inter")
def contingency(spark, sf_dir):
    return lb.contingency(ad.pixels(spark, sf_dir), KEY)


@query(f"WITH {RUNS_SQL} SELECT a.sample_id, a.label AS pred, b.label AS gt, sum(least(a.s + a.len, b.s + b.len) - greatest(a.s, b.s))::BIGINT AS inter FROM ra a JOIN rb b ON a.sample_id = b.sample_id AND a.s < b.s + b.len AND b.s < a.s + a.len GROUP BY ALL")
def interval_overlap(spark, sf_dir):
    return lb.interval_overlap(ad.runs(spark, sf_dir, 0), ad.runs(spark, sf_dir, 1), KEY)


def _tables(spark, sf_dir):
    px = ad.pixels(spark, sf_dir)
    ap, ag = lb.areas(px, KEY, "pred"), lb.areas(px, KEY, "gt")
    return px, ap, ag, lb.ious(lb.contingency(px, KEY), ap, ag, KEY)


@query(f"WITH {INTER_SQL} SELECT sample_id, pred, coalesce((SELECT max(gt) FROM iou i WHERE i.sample_id = ap.sample_id AND i.pred = ap.pred AND iou > 0.75), -1)::BIGINT AS link FROM ap")
def gt_link(spark, sf_dir):
    _, ap, _, iou = _tables(spark, sf_dir)
    return lb.gt_links(iou, ap, KEY)


@query(f"WITH {INTER_SQL} SELECT sample_id, gt, round(coalesce((SELECT max(iou) FROM iou i WHERE i.sample_id = ag.sample_id AND i.gt = ag.gt), 0), 6) AS best FROM ag")
def best_iou(spark, sf_dir):
    _, _, ag, iou = _tables(spark, sf_dir)
    return rounded(lb.best_iou(iou, ag, KEY, "gt"), "best")


def _panoptic(spark, sf_dir):
    px, ap, ag, iou = _tables(spark, sf_dir)
    return lb.panoptic(iou, ap, ag, px.select(*KEY).distinct(), KEY)


@query(f"WITH {INTER_SQL} SELECT sample_id, tp, np - tp AS fp, ng - tp AS fn, round(pq, 6) AS pq, round(t / nullif(tp, 0), 6) AS mean_iou, near_miss FROM score")
def pq_per_region(spark, sf_dir):
    return rounded(_panoptic(spark, sf_dir), "pq", "mean_iou")


@query(f"WITH {INTER_SQL} SELECT round(avg(pq), 6) AS mean_pq, count(*) AS n_regions FROM score")
def pq_mean(spark, sf_dir):
    return rounded(_panoptic(spark, sf_dir).agg(F.avg("pq").alias("mean_pq"), F.count("*").alias("n_regions")), "mean_pq")


@query(f"WITH {INTER_SQL} SELECT sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ng - tp)::BIGINT AS fn, round(sum(t) / sum(tp), 6) AS mean_iou, sum(near_miss)::BIGINT AS near_miss FROM score")
def pq_breakdown(spark, sf_dir):
    p = _panoptic(spark, sf_dir)
    return rounded(p.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), (F.sum(F.col("mean_iou") * F.col("tp")) / F.sum("tp")).alias("mean_iou"), F.sum("near_miss").alias("near_miss")), "mean_iou")


@query(f"""WITH {PIXELS_SQL}, two AS (SELECT sample_id, row, col, pred, gt FROM px UNION ALL SELECT sample_id, row, col, CASE WHEN gt > 0 AND v > 14 THEN gt + 1000 ELSE 0 END, gt FROM px),
i AS (SELECT sample_id, pred, gt, count(*) AS inter FROM two WHERE pred > 0 AND gt > 0 GROUP BY ALL), ap AS (SELECT sample_id, pred, count(*) AS a FROM two WHERE pred > 0 GROUP BY ALL),
ag AS (SELECT sample_id, gt, count(*) AS a FROM px WHERE gt > 0 GROUP BY ALL),
b AS (SELECT sample_id, gt, max(inter::DOUBLE / (ap.a + ag.a - inter)) AS iou FROM i JOIN ap USING (sample_id, pred) JOIN ag USING (sample_id, gt) WHERE inter::DOUBLE / (ap.a + ag.a - inter) > 0.75 GROUP BY ALL)
SELECT g.sample_id, coalesce(tp, 0)::BIGINT AS tp, round(2 * coalesce(t, 0) / (p + g), 6) AS pq FROM (SELECT sample_id, count(*) AS g FROM ag GROUP BY ALL) g JOIN (SELECT sample_id, count(*) AS p FROM ap GROUP BY ALL) USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS tp, sum(iou) AS t FROM b GROUP BY ALL) USING (sample_id)""")
def pq_multi(spark, sf_dir):
    px = ad.pixels(spark, sf_dir)
    two = px.select("sample_id", "pred", "gt").unionByName(px.select("sample_id", F.when((F.col("gt") > 0) & (F.col("v") > 14), F.col("gt") + 1000).otherwise(0).alias("pred"), "gt"))
    ap, ag = lb.areas(two, KEY, "pred"), lb.areas(px, KEY, "gt")
    return rounded(lb.panoptic_multi(lb.ious(lb.contingency(two, KEY), ap, ag, KEY), ap, ag, KEY), "pq")


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT sample_id, row, col, pred AS label FROM px WHERE pred > 0 AND v > 40), a AS (SELECT sample_id, row, col, gt AS label FROM px WHERE gt > 0),
s AS (SELECT a.sample_id, a.label, count(b.label)::DOUBLE / count(*) AS share FROM a LEFT JOIN b USING (sample_id, row, col) GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT a.sample_id, a.row, a.col, a.label + coalesce(t, 0) FROM a JOIN s ON a.sample_id = s.sample_id AND a.label = s.label AND share <= 0.2 LEFT JOIN b ON a.sample_id = b.sample_id AND a.row = b.row AND a.col = b.col
LEFT JOIN (SELECT sample_id, max(label) AS t FROM b GROUP BY ALL) m ON m.sample_id = a.sample_id WHERE b.label IS NULL""")
def instance_fusion(spark, sf_dir):
    px = ad.pixels(spark, sf_dir)
    base = px.where("pred > 0 AND v > 40").select("sample_id", "row", "col", F.col("pred").alias("label"))
    return lb.fuse(base, px.where("gt > 0").select("sample_id", "row", "col", F.col("gt").alias("label")), KEY, 0.2)


# ---------------------------------------------------------------- run-length masks

_ISLANDS = "isl AS (SELECT user_id, event_id, event_id // 40 AS image, event_id - row_number() OVER (PARTITION BY user_id % 3, event_id // 40 ORDER BY event_id) AS g, user_id % 3 AS cell FROM (SELECT DISTINCT event_id, user_id FROM events))"
_RUNS = f"WITH {_ISLANDS}, rn AS (SELECT image, cell, min(event_id % 40) AS s, count(*) AS n FROM isl GROUP BY image, cell, g)"


def _positions(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 40).alias("image"), (F.col("user_id") % 3).alias("cell"), (F.col("event_id") % 40).alias("pos"))


@query(_RUNS + " SELECT image, cell, string_agg(s || ' ' || n, ' ' ORDER BY s) AS rle FROM rn GROUP BY ALL")
def rle_encode(spark, sf_dir):
    return rle.to_text(rle.from_positions(_positions(spark, sf_dir), ["image", "cell"]), ["image", "cell"])


@query(_RUNS + " SELECT DISTINCT image, cell, event_id % 40 AS pos FROM isl")
def rle_decode(spark, sf_dir):
    text = rle.to_text(rle.from_positions(_positions(spark, sf_dir), ["image", "cell"]), ["image", "cell"])
    return rle.to_positions(text.select("image", "cell", F.inline(rle.runs(F.col("rle")))), ["image", "cell"])


@query("""WITH m AS (SELECT event_type AS sample_id, CASE WHEN event_id % 2 = 0 THEN 'iv' ELSE 'ex' END AS modality, 'c' || event_id AS cell_id, event_id, event_id * 6 + user_id % 5 AS s, 1 + user_id % 8 - (CASE WHEN event_id % 50 = 7 THEN 9 ELSE 0 END) AS n FROM events),
t AS (SELECT *, max(s + n) OVER (PARTITION BY sample_id, modality ORDER BY s, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM m WHERE n > 0 AND event_id % 30 <> 3)
SELECT sample_id, modality, cell_id, 'odd' AS error FROM m WHERE event_id % 30 = 3
UNION ALL SELECT sample_id, modality, cell_id, CASE WHEN n <= 0 THEN 'length' ELSE 'bounds' END FROM m WHERE event_id % 30 <> 3 AND (n <= 0 OR s + n > 5000)
UNION ALL SELECT sample_id, modality, cell_id, 'overlap' FROM t WHERE s < e""")
def rle_validate(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    start, n = F.col("event_id") * 6 + F.col("user_id") % 5, 1 + F.col("user_id") % 8 - F.when(F.col("event_id") % 50 == 7, 9).otherwise(0)
    masks = e.select(F.col("event_type").alias("sample_id"), F.when(F.col("event_id") % 2 == 0, "iv").otherwise("ex").alias("modality"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("cell_id"), F.when(F.col("event_id") % 30 == 3, start.cast("string")).otherwise(F.concat_ws(" ", start.cast("string"), n.cast("string"))).alias("rle"))
    return rle.problems(masks, masks.select("sample_id", "modality").distinct().select("*", F.lit(50).alias("h"), F.lit(100).alias("w")))


# ---------------------------------------------------------------- rasters

_GROWN = PIXELS_SQL + """,
fg AS (SELECT sample_id, row, col, pred AS label FROM px WHERE pred > 0),
rg AS (SELECT p.sample_id, p.row, p.col, p.prob, max(f.label) AS near FROM px p JOIN fg f ON p.sample_id = f.sample_id AND abs(p.row - f.row) + abs(p.col - f.col) = 1 WHERE p.pred = 0 GROUP BY ALL)"""


@query(f"WITH {_GROWN}, q AS (SELECT sample_id, quantile_cont(prob, 0.7) AS cut FROM rg GROUP BY ALL) SELECT * FROM fg UNION ALL SELECT sample_id, row, col, near FROM rg JOIN q USING (sample_id) WHERE prob >= cut")
def ring_grow(spark, sf_dir):
    px = _labelled(spark, sf_dir)
    return rs.grow(px, px.drop("label"), KEY, share=0.3)


@query(f"WITH {_GROWN} SELECT * FROM fg f WHERE NOT EXISTS (SELECT 1 FROM px p WHERE p.sample_id = f.sample_id AND abs(p.row - f.row) + abs(p.col - f.col) = 1 AND p.pred <> f.label)")
def ring_shrink(spark, sf_dir):
    return rs.shrink(_labelled(spark, sf_dir), None, KEY)


@query(f"""WITH {_GROWN}, n AS (SELECT f.*, p.prob, (SELECT count(*) FROM fg g WHERE g.sample_id = f.sample_id AND g.label = f.label AND abs(g.row - f.row) + abs(g.col - f.col) = 1) AS k FROM fg f JOIN px p USING (sample_id, row, col)),
q AS (SELECT sample_id, label, quantile_cont(prob, 0.25) AS cut FROM n WHERE k < 4 AND label % 2 = 0 GROUP BY ALL),
g AS (SELECT n.*, coalesce(k < 4 AND prob <= cut, false) AS gone FROM n LEFT JOIN q USING (sample_id, label)), w AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY sample_id, label) AS rest FROM g)
SELECT sample_id, row, col, label FROM w WHERE rest < 8 OR NOT gone""")
def shrink_pairs(spark, sf_dir):
    px = _labelled(spark, sf_dir).where("label > 0")
    return rs.shrink_labels(px, px.where("label % 2 = 0").select("sample_id", "label").distinct(), KEY)


@query(f"WITH {PIXELS_SQL} SELECT DISTINCT sample_id, row + dr AS row, col + dc AS col FROM px, range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE v > 45")
def dilate(spark, sf_dir):
    return rs.dilate(ad.pixels(spark, sf_dir).where("v > 45"), KEY)


@query(f"WITH {_GROWN} SELECT * FROM fg f WHERE 4 = (SELECT count(*) FROM fg g WHERE g.sample_id = f.sample_id AND g.label = f.label AND abs(g.row - f.row) + abs(g.col - f.col) = 1) AND row BETWEEN 1 AND 498 AND col BETWEEN 1 AND 6")
def core_target(spark, sf_dir):
    px = _labelled(spark, sf_dir)
    return rs.core(px, KEY, px.select("sample_id").distinct().select("*", F.lit(500).alias("h"), F.lit(8).alias("w")), border=1)


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT sample_id, pred AS idx, avg(row) AS y, avg(col) AS x FROM px WHERE pred > 0 GROUP BY ALL)
SELECT sample_id, idx, greatest(0, least(round_even(y, 0)::BIGINT - 32, 500 - 64)) AS row0, greatest(0, least(round_even(x, 0)::BIGINT - 32, 8 - 64)) AS col0 FROM c""")
def tile_origins(spark, sf_dir):
    c = pt.centroids(_labelled(spark, sf_dir), KEY).withColumnRenamed("label", "idx")
    return rs.tile_origins(c, c.select("sample_id").distinct().select("*", F.lit(500).alias("h"), F.lit(8).alias("w")), KEY, 64)


@query(f"""WITH {PIXELS_SQL}, s AS (SELECT sample_id, row * 10 + col AS idx, row, col FROM px WHERE v > 48), b AS (SELECT DISTINCT sample_id, row, col FROM px WHERE pred > 0 AND pred % 4 = 0),
d AS (SELECT sample_id, row + dr AS row, col + dc AS col, min(idx) AS idx FROM s, range(-2, 3) p(dr), range(-2, 3) q(dc) WHERE dr * dr + dc * dc <= 4 AND row + dr BETWEEN 0 AND 499 AND col + dc BETWEEN 0 AND 7 GROUP BY ALL),
k AS (SELECT d.* FROM d ANTI JOIN b USING (sample_id, row, col)), l AS (SELECT sample_id, idx, row_number() OVER (PARTITION BY sample_id ORDER BY idx) AS label FROM (SELECT DISTINCT sample_id, idx FROM k))
SELECT sample_id, row, col, label::INT AS label FROM k JOIN l USING (sample_id, idx)""")
def pseudo_label_disks(spark, sf_dir):
    px = ad.pixels(spark, sf_dir)
    seeds = px.where("v > 48").select("sample_id", (F.col("row") * 10 + F.col("col")).alias("idx"), F.col("row").cast("double").alias("y"), F.col("col").cast("double").alias("x"))
    sizes = px.select("sample_id").distinct().select("*", F.lit(500).alias("h"), F.lit(8).alias("w"))
    return rs.paint_disks(seeds, px.where("pred > 0 AND pred % 4 = 0"), sizes, KEY, 2)


@query(f"WITH {PIXELS_SQL} SELECT sample_id, (row // 2)::BIGINT AS row, col, round(sum(prob * v) / sum(v), 6) + 0.0 AS p FROM px GROUP BY ALL")
def tile_stitch(spark, sf_dir):
    px = ad.pixels(spark, sf_dir)
    return rounded(rs.stitch(px.select("sample_id", F.floor(F.col("row") / 2).alias("row"), "col", F.col("prob").alias("p"), F.col("v").alias("w")), KEY), "p")


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75,
count(*) FILTER (l_extendedprice >= 0 AND l_extendedprice < 20000) AS bin_0, count(*) FILTER (l_extendedprice >= 20000 AND l_extendedprice < 50000) AS bin_1 FROM lineitem GROUP BY ALL""")
def grouped_summary(spark, sf_dir):
    out = ms.grouped_summary(ad.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 20000.0, 50000.0])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "q25", "q50", "q75")})


_SETTINGS = {"all": "true", "bright": "v > 20", "core": "prob >= -0.2", "odd": "label % 2 = 1"}
_SPREAD = f"""WITH {PIXELS_SQL}, st(setting, o) AS (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(_SETTINGS))}),
sx AS (SELECT setting, sample_id, CASE WHEN (CASE o {" ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_SETTINGS.values()))} END) THEN label ELSE 0 END AS pred, gt FROM (SELECT *, pred AS label FROM px), st),
si AS (SELECT setting, sample_id, pred, gt, count(*) AS inter FROM sx WHERE pred > 0 AND gt > 0 GROUP BY ALL), sp AS (SELECT setting, sample_id, pred, count(*) AS a FROM sx WHERE pred > 0 GROUP BY ALL),
sg AS (SELECT setting, sample_id, gt, count(*) AS a FROM sx WHERE gt > 0 GROUP BY ALL), su AS (SELECT si.*, inter::DOUBLE / (sp.a + sg.a - inter) AS iou FROM si JOIN sp USING (setting, sample_id, pred) JOIN sg USING (setting, sample_id, gt)),
sm AS (SELECT d.setting, d.sample_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(tp, 0) AS tp, coalesce(t, 0) AS t FROM (SELECT DISTINCT setting, sample_id FROM sx) d
  LEFT JOIN (SELECT setting, sample_id, count(*) AS np FROM sp GROUP BY ALL) USING (setting, sample_id) LEFT JOIN (SELECT setting, sample_id, count(*) AS ng FROM sg GROUP BY ALL) USING (setting, sample_id)
  LEFT JOIN (SELECT setting, sample_id, count(*) AS tp, sum(iou) AS t FROM su WHERE iou > 0.75 GROUP BY ALL) USING (setting, sample_id))"""


@query(f"""{_SPREAD} SELECT setting, round(avg(CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE WHEN np = 0 OR ng = 0 THEN 0 ELSE 2 * t / (np + ng) END), 6) AS pq, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ng - tp)::BIGINT AS fn FROM sm GROUP BY ALL""")
def setting_grid(spark, sf_dir):
    return rounded(lb.setting_grid(_labelled(spark, sf_dir), KEY, _SETTINGS), "pq")


@query(f"""WITH {INTER_SQL}, m AS (SELECT sample_id, count(DISTINCT pred) AS pred_met, count(DISTINCT gt) AS gt_met FROM iou WHERE iou > 0.5 GROUP BY ALL)
SELECT sample_id, np AS n_pred, ng AS n_gt, coalesce(pred_met, 0)::BIGINT AS pred_met, coalesce(gt_met, 0)::BIGINT AS gt_met FROM score LEFT JOIN m USING (sample_id)""")
def mask_agreement(spark, sf_dir):
    return lb.agreement(ad.pixels(spark, sf_dir), KEY)


@query(f"""WITH {PIXELS_SQL}, q(quantile) AS (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)), f AS (SELECT sample_id, row, col, pred AS label, prob FROM px WHERE pred > 0),
c AS (SELECT sample_id, label, 0.1::DOUBLE AS quantile, quantile_cont(prob, 0.1) AS cut FROM f GROUP BY ALL UNION ALL SELECT sample_id, label, 0.25, quantile_cont(prob, 0.25) FROM f GROUP BY ALL UNION ALL SELECT sample_id, label, 0.5, quantile_cont(prob, 0.5) FROM f GROUP BY ALL)
SELECT sample_id, row, col, label, quantile FROM f JOIN c USING (sample_id, label) WHERE prob >= cut""")
def mask_variants(spark, sf_dir):
    return rs.quantile_variants(_labelled(spark, sf_dir), KEY, [0.1, 0.25, 0.5])


@query(f"WITH {PIXELS_SQL} SELECT a.sample_id, round(corr(a.v, b.v), 6) + 0.0 AS ncc, count(*) AS n FROM px a JOIN px b ON a.sample_id = b.sample_id AND b.row = a.row + 1 AND b.col = a.col GROUP BY ALL")
def aligned_correlation(spark, sf_dir):
    px = ad.pixels(spark, sf_dir).select("sample_id", "row", "col", "v")
    return rounded(rs.aligned_correlation(px, px, KEY, 1, 0), "ncc")
