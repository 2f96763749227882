"""Queries on groups of samples: consensus, margins, gates, sweeps, result checks, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import consensus as cs
from tessera.operators import kernels, learn
from tessera.operators import matching as mt
from tessera.operators import metrics as ms
from tessera.operators import registration as rg
from tessera.plans import adapters as ad
from tessera.plans import rematch as rm
from tessera.plans.adapters import CANDIDATES_SQL, GATES_SQL, INTER_SQL, PAIRS_SQL, POINTS_SQL, REGION_PAIRS_SQL, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- consensus


@query("""WITH r AS (SELECT r_name AS subject, n_nationkey % 3 + 10.0 AS h, 10.0 AS w, n_nationkey * 7 % 10 AS s0, CASE WHEN r_regionkey % 2 = 0 THEN 2 ELSE 8 END AS s1 FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT subject, avg(CASE WHEN abs(ln(h / w)) < 0.1 THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN s0 > s1 THEN 1.0 ELSE 0.0 END) AS p FROM r GROUP BY ALL)
SELECT subject, CASE WHEN s >= 0.65 AND p >= 0.65 THEN 0 WHEN s >= 0.65 AND 1 - p >= 0.65 THEN 1 END AS mode FROM a""")
def subject_mode(spark, sf_dir):
    n, r = ad.table(spark, sf_dir, "nation"), ad.table(spark, sf_dir, "region")
    rows = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 nations
    side = F.when(F.col("r_regionkey") % 2 == 0, 2).otherwise(8)
    return cs.subject_modes(rows.select(F.col("r_name").alias("subject"), (F.col("n_nationkey") % 3 + 10.0).alias("h"), F.lit(10.0).alias("w"), (F.col("n_nationkey") * 7 % 10).alias("score_0"), side.alias("score_1")))


@query(f"""WITH {CANDIDATES_SQL}, c AS (SELECT subject, cand_idx::VARCHAR AS sample_id, land_x / 600 AS cx, land_y / 600 AS cy FROM cand),
p AS (SELECT a.subject, a.sample_id AS sid, a.cx AS ax, a.cy AS ay, count(*) AS n, quantile_cont(b.cx, 0.5) AS mx, quantile_cont(b.cy, 0.5) AS my FROM c a JOIN c b ON a.subject = b.subject AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.1 GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, sqrt((ax - 0.48::DOUBLE) * (ax - 0.48::DOUBLE) + (ay - 0.54::DOUBLE) * (ay - 0.54::DOUBLE)), sid) AS r FROM p) WHERE r = 1)
SELECT c.subject, c.sample_id FROM c JOIN k USING (subject) WHERE sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) <= 0.1""")
def consistency_gate(spark, sf_dir):
    c = ad.candidates(spark, sf_dir)
    return cs.consistent_regions(c.select("subject", F.col("cand_idx").cast("string").alias("sample_id"), (F.col("land_x") / 600).alias("cx"), (F.col("land_y") / 600).alias("cy")), 0.1)


def _mode_round(name: str, voters: str) -> str:
    return f"""
{name}_in AS (SELECT * FROM (
  SELECT v.subject, q.sample_id AS cs, q.cand_idx AS cc, v.sample_id, v.cand_idx, v.z, v.angle, v.land_x, v.land_y, row_number() OVER (PARTITION BY v.subject, q.sample_id, q.cand_idx, v.sample_id ORDER BY v.z DESC, v.cand_idx) AS k
  FROM {voters} v JOIN sc q ON v.subject = q.subject AND abs(v.angle - q.angle) < 3 AND sqrt((v.land_x - q.land_x) * (v.land_x - q.land_x) + (v.land_y - q.land_y) * (v.land_y - q.land_y)) < 70) WHERE k = 1),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY support DESC, cs, cc) AS k FROM (SELECT subject, cs, cc, sum(z) AS support, count(*) FILTER (z > 0) AS n FROM {name}_in GROUP BY ALL)) WHERE k = 1),
{name}_mem AS (SELECT i.*, b.support, b.n FROM {name}_in i JOIN {name}_best b USING (subject, cs, cc) WHERE z > 0),
{name} AS (SELECT subject, support, n, quantile_cont(angle, 0.5) AS angle, quantile_cont(land_x, 0.5) AS land_x, quantile_cont(land_y, 0.5) AS land_y FROM {name}_mem GROUP BY subject, support, n HAVING n >= 2)"""


@query(f"""WITH {CANDIDATES_SQL}, st AS (SELECT sample_id, quantile_cont(score, 0.5) AS m, stddev_pop(score) AS s FROM cand GROUP BY ALL),
sc AS (SELECT cand.* REPLACE (greatest((score - m) / (s + 1e-6::DOUBLE), 0) AS z) FROM cand JOIN st USING (sample_id)),{_mode_round('one', 'sc')},
lf AS (SELECT sc.* FROM sc ANTI JOIN (SELECT sample_id, subject FROM one_mem SEMI JOIN one USING (subject)) USING (sample_id, subject)),{_mode_round('two', 'lf')}
SELECT subject, 0 AS mode_idx, round(angle, 6) + 0.0 AS angle, round(land_x, 6) AS land_x, round(land_y, 6) AS land_y, round(support, 6) AS support, n FROM one
UNION ALL SELECT t.subject, 1, round(t.angle, 6) + 0.0, round(t.land_x, 6), round(t.land_y, 6), round(t.support, 6), t.n FROM two t JOIN one o USING (subject) WHERE t.support >= 0.45 * o.support""")
def vote_modes(spark, sf_dir):
    out = cs.vote_modes(ad.candidates(spark, sf_dir), ["subject"])
    return rounded(out, "angle", "land_x", "land_y", "support")


def _cluster(name: str, left: str) -> str:
    return f"""
{name}_p AS (SELECT v.*, q.idx AS c FROM {left} v JOIN {left} q ON v.subject = q.subject AND abs(v.angle - q.angle) <= 4 AND sqrt((v.land_x - q.land_x) * (v.land_x - q.land_x) + (v.land_y - q.land_y) * (v.land_y - q.land_y)) <= 120),
{name}_b AS (SELECT b.* FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY w DESC, c) AS k FROM (SELECT subject, c, sum(weight) AS w FROM {name}_p GROUP BY ALL)) b JOIN tot USING (subject) WHERE k = 1 AND w >= 0.05::DOUBLE * total),
{name}_m AS (SELECT p.*, b.w FROM {name}_p p JOIN {name}_b b USING (subject, c)),
{name} AS (SELECT subject, w, quantile_cont(angle, 0.5) AS angle, quantile_cont(land_x, 0.5) AS land_x, quantile_cont(land_y, 0.5) AS land_y, count(*) AS n FROM {name}_m GROUP BY subject, w)"""


@query(f"""WITH {CANDIDATES_SQL}, ps AS (SELECT subject, cand_idx AS idx, greatest(score, 0) AS weight, angle, land_x, land_y FROM cand), tot AS (SELECT subject, sum(weight) AS total FROM ps GROUP BY ALL),{_cluster('one', 'ps')},
rs AS (SELECT * FROM ps ANTI JOIN one_m USING (subject, idx)),{_cluster('two', 'rs')}
SELECT subject, 0 AS mode_idx, round(angle, 6) + 0.0 AS angle, round(land_x, 6) AS land_x, round(land_y, 6) AS land_y, round(w, 6) AS support, n FROM one
UNION ALL SELECT subject, 1, round(angle, 6) + 0.0, round(land_x, 6), round(land_y, 6), round(w, 6), n FROM two""")
def cluster_modes(spark, sf_dir):
    c = ad.candidates(spark, sf_dir).select("subject", F.col("cand_idx").alias("idx"), F.greatest("score", F.lit(0.0)).alias("weight"), "angle", "land_x", "land_y")
    return rounded(cs.cluster_modes(c, ["subject"], least_share=0.05), "angle", "land_x", "land_y", "support")


_VOLUME = CANDIDATES_SQL + """,
vb AS (SELECT subject, sample_id, floor(angle / 3)::BIGINT AS ba, floor(land_x / 60)::BIGINT AS bx, floor(land_y / 60)::BIGINT AS "by", max(score) AS score FROM cand GROUP BY ALL),
vv AS (SELECT subject, ba, bx, "by", sum(score) AS support, count(*) AS n FROM vb GROUP BY ALL),
v1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY support DESC, ba, bx, "by") AS k FROM vv) WHERE k = 1),
v2 AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.subject ORDER BY v.support DESC, v.ba, v.bx, v."by") AS k FROM vv v JOIN v1 USING (subject) WHERE abs(v.ba - v1.ba) * 3 > 9) WHERE k = 1)"""


@query(f"""WITH {_VOLUME} SELECT subject, ba, bx, "by", round(support, 6) AS support, n, 0 AS mode_idx FROM v1 UNION ALL SELECT subject, ba, bx, "by", round(support, 6), n, 1 FROM v2""")
def volume_modes(spark, sf_dir):
    return rounded(cs.volume_modes(ad.candidates(spark, sf_dir), ["subject"]), "support")


@query(f"""WITH {CANDIDATES_SQL}, e AS (SELECT sample_id, cand_idx, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_idx) AS place, abs(land_x - 300) / 10 AS err FROM cand),
s AS (SELECT sample_id, bool_or(err < 5 AND place = 1) AS one, bool_or(err < 5 AND place <= 5) AS few, bool_or(err < 5) AS anyc, min(err) AS best FROM e GROUP BY ALL)
SELECT count(*) AS regions, count(*) FILTER (one) AS first_correct, count(*) FILTER (few) AS top_correct, count(*) FILTER (anyc) AS any_correct, round(quantile_cont(best, 0.5), 6) AS best_error FROM s""")
def pose_diagnostics(spark, sf_dir):
    err = F.abs(F.col("land_x") - 300) / 10
    rows = mt.top_list(ad.candidates(spark, sf_dir), 1 << 30, "score").withColumns({"err": err, "correct": err < 5})
    return rounded(ms.pose_diagnostics(rows), "best_error")


@query("""WITH r AS (SELECT c_nationkey % 3 AS grp, c_custkey AS pos, sha1(c_mktsegment || '|' || (c_custkey % 7)) AS dup_key FROM customer)
SELECT grp, pos, dup_key FROM (SELECT *, row_number() OVER (PARTITION BY grp, dup_key ORDER BY pos) AS k FROM r) WHERE k = 1""")
def voters_once(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("grp"), F.col("c_custkey").alias("pos"), "c_mktsegment", (F.col("c_custkey") % 7).alias("size"))
    return cs.voters_once(c.withColumn("dup_key", cs.content_key("c_mktsegment", "size")), ["grp"]).select("grp", "pos", "dup_key")


@query("SELECT (c_custkey * 13 % 40)::VARCHAR AS dup_key, string_agg(c_name, ',' ORDER BY c_name) AS sample_ids, count(*) AS n FROM customer GROUP BY ALL")
def scan_inputs(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13 % 40).cast("string").alias("dup_key"), F.col("c_name").alias("sample_id"))
    return cs.scan_inputs(c).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(f"""WITH {CANDIDATES_SQL}, p AS (SELECT subject, cand_idx::VARCHAR AS sample_id, land_x, land_y FROM cand),
o AS (SELECT a.subject, a.sample_id, a.land_x, a.land_y, quantile_cont(b.land_x, 0.5) AS mx, quantile_cont(b.land_y, 0.5) AS my FROM p a JOIN p b ON a.subject = b.subject AND a.sample_id <> b.sample_id GROUP BY ALL)
SELECT p.subject, p.sample_id, round(coalesce(sqrt((o.land_x - mx) * (o.land_x - mx) + (o.land_y - my) * (o.land_y - my)), 0), 6) AS dist FROM p LEFT JOIN o USING (subject, sample_id)""")
def landing_dist(spark, sf_dir):
    c = ad.candidates(spark, sf_dir).select("subject", F.col("cand_idx").cast("string").alias("sample_id"), "land_x", "land_y")
    return rounded(cs.landing_distance(c, ["subject"]), "dist")


@query(f"""WITH {CANDIDATES_SQL} SELECT CASE WHEN atan2(c, a) >= 0 THEN 0 ELSE 1 END AS cluster, round(quantile_cont(a, 0.5), 6) AS a, round(quantile_cont(b, 0.5), 6) + 0.0 AS b, round(quantile_cont(c, 0.5), 6) + 0.0 AS c, round(quantile_cont(d, 0.5), 6) AS d, count(*) AS n
FROM cand WHERE subject <> 'm1' AND abs(a * d - b * c) > 0.65 AND abs(a * d - b * c) < 1.3 GROUP BY ALL""")
def linear_priors(spark, sf_dir):
    return rounded(cs.linear_priors(ad.candidates(spark, sf_dir).where("subject <> 'm1'").select("subject", "pose")), "a", "b", "c", "d")


# ---------------------------------------------------------------- margins and choices

_MARGIN = CANDIDATES_SQL + """,
mg AS (SELECT a.*, a.score - coalesce((SELECT max(b.score) FROM cand b WHERE b.sample_id = a.sample_id AND b.cand_idx <> a.cand_idx AND (abs(a.angle - b.angle) > 3 OR sqrt((a.land_x - b.land_x) * (a.land_x - b.land_x) + (a.land_y - b.land_y) * (a.land_y - b.land_y)) > 60)), 0) AS margin FROM cand a)"""


@query(f"WITH {_MARGIN} SELECT sample_id, cand_idx, round(margin, 6) + 0.0 AS margin FROM mg")
def soft_margin(spark, sf_dir):
    return rounded(mt.margins(ad.candidates(spark, sf_dir), "score", "margin").select("sample_id", "cand_idx", "margin"), "margin")


@query(f"""WITH {CANDIDATES_SQL}, v AS (SELECT *, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6::DOUBLE) + (z - avg(z) OVER w) / (stddev_pop(z) OVER w + 1e-6::DOUBLE) AS value FROM cand WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, cand_idx, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, cand_idx) AS k FROM v) WHERE k = 1""")
def pose_choice(spark, sf_dir):
    return rounded(mt.choose(ad.candidates(spark, sf_dir), "mix").select("sample_id", "cand_idx", "value"), "value")


@query(f"""WITH {_MARGIN} SELECT sample_id, cand_idx, margin >= 3 OR z >= 5 AS gated FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY (margin >= 3 OR z >= 5) DESC, margin DESC, score DESC, cand_idx) AS k FROM mg) WHERE k = 1""")
def gated_choice(spark, sf_dir):
    rows = mt.margins(ad.candidates(spark, sf_dir), "score", "margin").withColumn("gated", mt.evidence_gate(F.col("margin"), F.col("z")))
    return mt.choose_gated(rows, F.col("gated")).select("sample_id", "cand_idx", "gated")


@query(f"""WITH {CANDIDATES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_idx) = 1 AS chosen, row_number() OVER (PARTITION BY sample_id ORDER BY image DESC, cand_idx) = 1 AS best FROM cand),
p AS (SELECT sample_id, max(image) FILTER (chosen) AS ci, max(score) FILTER (chosen) AS s FROM c GROUP BY ALL),
w AS (SELECT c.*, best AND image - ci >= 0.03::DOUBLE AND s - score < 30 AS swap FROM c JOIN p USING (sample_id)), x AS (SELECT *, bool_or(swap) OVER (PARTITION BY sample_id) AS any_swap FROM w)
SELECT sample_id, cand_idx, NOT chosen AS replaced FROM x WHERE CASE WHEN any_swap THEN swap ELSE chosen END""")
def image_rerank(spark, sf_dir):
    c = ad.candidates(spark, sf_dir)
    first = mt.top_list(c, 1, "score").select("sample_id", "cand_idx", F.lit(True).alias("chosen"))
    c = c.join(first, ["sample_id", "cand_idx"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return mt.rerank(c, votes=30.0).select("sample_id", "cand_idx", "replaced")


@query(f"WITH {CANDIDATES_SQL} SELECT sample_id, cand_idx, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_idx) AS place FROM cand) WHERE place <= 5")
def top_candidates(spark, sf_dir):
    return mt.top_list(ad.candidates(spark, sf_dir), 5, "score").select("sample_id", "cand_idx", "place")


@query(f"""WITH {CANDIDATES_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand_idx) AS k FROM cand) WHERE k <= 5)
SELECT u.subject, u.sample_id AS sample_id_u, u.cand_idx AS cand_idx_u, v.sample_id AS sample_id_v, v.cand_idx AS cand_idx_v,
round(least(1, ((u.land_x - v.land_x) * (u.land_x - v.land_x) + (u.land_y - v.land_y) * (u.land_y - v.land_y)) / 3600) + least(1, ((u.a - v.a) * (u.a - v.a) + (u.b - v.b) * (u.b - v.b) + (u.c - v.c) * (u.c - v.c) + (u.d - v.d) * (u.d - v.d)) / 0.0036::DOUBLE), 6) AS psi
FROM t u JOIN t v ON u.subject = v.subject AND u.sample_id < v.sample_id""")
def joint_penalties(spark, sf_dir):
    return rounded(mt.penalties(mt.top_list(ad.candidates(spark, sf_dir), 5, "score"), ["subject"]), "psi")


@query(f"""WITH {CANDIDATES_SQL}, o AS (SELECT DISTINCT subject, sample_id, ox, oy FROM cand), e AS (SELECT a.subject, a.sample_id AS u, b.sample_id AS v, exp(-sqrt((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy)) / 400) AS e FROM o a JOIN o b ON a.subject = b.subject AND a.sample_id <> b.sample_id),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY subject, u) AS w FROM e) SELECT a.subject, a.u, a.v, round(0.5 * (a.w + b.w), 6) AS w FROM w a JOIN w b ON a.subject = b.subject AND a.u = b.v AND a.v = b.u""")
def offset_weights(spark, sf_dir):
    o = ad.candidates(spark, sf_dir).select("subject", "sample_id", "ox", "oy").distinct()
    return rounded(mt.offset_weights(o, ["subject"]), "w")


@query(f"WITH {PAIRS_SQL}, b AS (SELECT * FROM prs WHERE k % 2 = 0 AND prob > 0.5) SELECT sample_id, k, i, j, prob FROM prs p WHERE k % 2 = 1 AND prob >= 0.1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.sample_id = p.sample_id AND b.i = p.i) AND NOT EXISTS (SELECT 1 FROM b WHERE b.sample_id = p.sample_id AND b.j = p.j)")
def additive_pairs(spark, sf_dir):
    p = ad.scored_pairs(spark, sf_dir)
    return mt.additive_pairs(p.where("k % 2 = 0 AND prob > 0.5"), p.where("k % 2 = 1")).select("sample_id", "k", "i", "j", "prob")


_GATES = {"margin": "margin >= 3", "z": "z >= 2", "either": "margin >= 3 OR z >= 2", "both": "margin >= 3 AND z >= 2", "score": "score > 25"}


@query(f"WITH {_MARGIN}, n(gate, o) AS (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(_GATES)) + "), x AS (SELECT gate, CASE o " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_GATES.values())) + """ END AS kept, cand_idx % 3 = 0 AS correct FROM mg, n)
SELECT gate, count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND correct) AS good, count(*) FILTER (kept AND NOT correct) AS wrong FROM x GROUP BY ALL""")
def gate_sweep(spark, sf_dir):
    rows = mt.margins(ad.candidates(spark, sf_dir), "score", "margin").withColumn("correct", F.col("cand_idx") % 3 == 0)
    return mt.gate_sweep(rows, {n: F.expr(p) for n, p in _GATES.items()})


@query(f"WITH {CANDIDATES_SQL}, q AS (SELECT sample_id, quantile_cont(image, 0.8) AS cut FROM cand GROUP BY ALL) SELECT sample_id, cand_idx FROM cand JOIN q USING (sample_id) WHERE image >= cut")
def top_fraction(spark, sf_dir):
    return mt.top_fraction(ad.candidates(spark, sf_dir), ["sample_id"], "image", 0.2).select("sample_id", "cand_idx")


@query(f"WITH {CANDIDATES_SQL} SELECT sample_id, cand_idx, a * 40 + b * 30 + tx >= 0 AND a * 40 + b * 30 + tx < 60 AND c * 40 + d * 30 + ty >= 0 AND c * 40 + d * 30 + ty < 45 AS inside FROM cand")
def field_inside(spark, sf_dir):
    n = lambda v: F.lit(float(v))
    return ad.candidates(spark, sf_dir).select("sample_id", "cand_idx", mt.field_inside(F.col("pose"), n(60), n(80), n(45), n(60)).alias("inside"))


# ---------------------------------------------------------------- scores and sweeps


@query(f"""WITH {INTER_SQL} SELECT subject, sum(CASE WHEN tp % 2 = 0 THEN tp ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN tp % 2 = 0 THEN np - tp ELSE 0 END)::BIGINT AS fp, sum(ng)::BIGINT - sum(CASE WHEN tp % 2 = 0 THEN tp ELSE 0 END)::BIGINT AS fn,
count(*) FILTER (tp % 2 = 0) AS kept, count(*) FILTER (tp % 2 = 0 AND near_miss > 1) AS kept_wrong, round(2.0 * sum(CASE WHEN tp % 2 = 0 THEN tp ELSE 0 END)::DOUBLE / (sum(CASE WHEN tp % 2 = 0 THEN np ELSE 0 END) + sum(ng)), 6) AS f1 FROM score GROUP BY ROLLUP (subject)""")
def pair_f1_rollup(spark, sf_dir):
    from tessera.plans.catalog_labels import _panoptic

    subject = ad.pixels(spark, sf_dir).select("sample_id", "subject").distinct()
    p = _panoptic(spark, sf_dir).join(subject, "sample_id")
    rows = p.select("subject", "sample_id", "tp", (F.col("tp") + F.col("fp")).alias("pred"), (F.col("tp") + F.col("fn")).alias("n_gt"), (F.col("tp") % 2 == 0).alias("kept"), (F.col("near_miss") > 1).alias("wrong"))
    return rounded(ms.pair_f1(rows), "f1")


@query(f"WITH {INTER_SQL} SELECT round(0.25 * avg(pq) FILTER (tp % 2 = 0) + 0.25 * avg(pq) FILTER (tp % 2 = 1) + 0.5 * (2.0 * sum(tp)::DOUBLE / (sum(np) + sum(ng))), 6) AS full_score FROM score")
def full_score(spark, sf_dir):
    from tessera.plans.catalog_labels import _panoptic

    tp, pred, gt = F.sum("tp"), F.sum(F.col("tp") + F.col("fp")), F.sum(F.col("tp") + F.col("fn"))
    even, odd = F.avg(F.when(F.col("tp") % 2 == 0, F.col("pq"))), F.avg(F.when(F.col("tp") % 2 == 1, F.col("pq")))
    return rounded(_panoptic(spark, sf_dir).agg(ms.full_score(even, odd, ms.f1(tp, pred, gt)).alias("full_score")), "full_score")


_GRID = ", ".join(f"({t}::DOUBLE)" for t in ms.THRESHOLDS)
_TABLE = f"""{PAIRS_SQL}, th(threshold) AS (VALUES {_GRID}),
tt AS (SELECT threshold, coalesce(sum(y::INT) FILTER (prob >= threshold), 0)::BIGINT AS tp, count(*) FILTER (prob >= threshold) AS pred FROM th, prs GROUP BY ALL),
ft AS (SELECT *, 2.0 * tp / (pred + 50) AS f1 FROM tt)"""


@query(f"WITH {_TABLE} SELECT threshold, tp, pred, round(f1, 6) AS f1 FROM ft")
def threshold_sweep(spark, sf_dir):
    return rounded(ms.threshold_table(ad.scored_pairs(spark, sf_dir), 50), "f1")


@query(f"WITH {_TABLE} SELECT threshold, tp, pred, round(f1, 6) AS f1 FROM ft ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return rounded(ms.best_threshold(ms.threshold_table(ad.scored_pairs(spark, sf_dir), 50)), "f1")


_GATE_GRID = f"""{GATES_SQL}, {REGION_PAIRS_SQL}, th(pair_threshold) AS (VALUES {_GRID}), ta AS (SELECT i, (i * 0.05::DOUBLE) AS tau0, round(i * 0.05::DOUBLE, 2) AS tau FROM range(21) t(i)),
kp AS (SELECT tau, g.* FROM ta, gates g WHERE registered AND (v10 OR prob >= tau)),
kc AS (SELECT ta.tau, count(sample_id) AS kept, count(*) FILTER (has_gt AND correct) AS correct, count(*) FILTER (has_gt AND NOT correct) AS wrong FROM ta LEFT JOIN kp USING (tau) GROUP BY ALL),
pc AS (SELECT ta.tau, th.pair_threshold, coalesce(sum(p.y::INT), 0)::BIGINT AS tp, count(p.k) AS pred FROM ta CROSS JOIN th LEFT JOIN (SELECT tau, prs.* FROM kp JOIN prs USING (sample_id)) p ON p.tau = ta.tau AND p.prob >= th.pair_threshold GROUP BY ALL),
pf AS (SELECT *, 2.0 * tp / (pred + 50) AS f1 FROM pc), pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY f1 DESC, pair_threshold) AS r FROM pf) WHERE r = 1),
gg AS (SELECT tau, kept, correct, wrong, f1, pair_threshold, tp, pred FROM kc JOIN pb USING (tau))"""


def _gate_grid(spark, sf_dir):
    return ms.gate_grid(ad.gate_regions(spark, sf_dir), ad.region_pairs(spark, sf_dir), 50)


@query(f"WITH {_GATE_GRID} SELECT * REPLACE (round(f1, 6) AS f1) FROM gg")
def gate_grid(spark, sf_dir):
    return rounded(_gate_grid(spark, sf_dir), "f1")


@query(f"WITH {_GATE_GRID} SELECT min(tau) FILTER (wrong = 0) AS conservative, (SELECT tau FROM gg ORDER BY f1 DESC, tau DESC LIMIT 1) AS aggressive FROM gg")
def gate_choice(spark, sf_dir):
    return ms.gate_choice(_gate_grid(spark, sf_dir))


@query(f"WITH {GATES_SQL} SELECT sample_id, registered AND (v10 OR prob >= 0.6) AS kept, registered AND v10 AS kept_without_tau FROM gates")
def gate_flags(spark, sf_dir):
    r = ad.gate_regions(spark, sf_dir)
    flag = lambda tau: mt.kept(F.col("prob"), F.col("v10"), F.col("registered"), F.lit(tau).cast("double"))
    return r.select("sample_id", flag(0.6).alias("kept"), flag(None).alias("kept_without_tau"))


_SEARCH = POINTS_SQL + """, cfg AS (SELECT * FROM (VALUES (4.0::DOUBLE), (8.0::DOUBLE)) a(distance), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) b(min_brightness), (VALUES (1.2::DOUBLE), (2.0::DOUBLE)) c(ratio)),
kx AS (SELECT b.min_brightness, ex.* FROM (SELECT DISTINCT min_brightness FROM cfg) b, ex), kb AS (SELECT * FROM (SELECT *, count(*) FILTER (brightness >= min_brightness) OVER (PARTITION BY min_brightness, sample_id) AS n FROM kx) WHERE brightness >= min_brightness OR n < 3),
nb AS (SELECT min_brightness, a.sample_id, a.idx AS i, b.idx AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pj a JOIN kb b USING (sample_id)),
rk AS (SELECT *, row_number() OVER w AS r, lead(d) OVER w AS second FROM nb WINDOW w AS (PARTITION BY min_brightness, sample_id, i ORDER BY d, j)),
sp AS (SELECT cfg.distance, cfg.ratio, rk.* FROM rk JOIN cfg USING (min_brightness) WHERE r = 1 AND d < distance), q AS (SELECT *, row_number() OVER (PARTITION BY distance, min_brightness, ratio, sample_id, j ORDER BY d, i) AS k FROM sp),
s AS (SELECT distance, min_brightness, ratio, count(*) FILTER ((i + j) % 3 = 0) AS tp, count(*) AS pred FROM q WHERE k = 1 AND (second IS NULL OR second >= ratio * greatest(d, 0.5)) GROUP BY ALL)"""


@query(f"WITH {_SEARCH} SELECT *, round(2.0 * tp / (pred + 100), 6) AS f1 FROM s")
def match_search(spark, sf_dir):
    iv, ex = ad.projected(spark, sf_dir), ad.points(spark, sf_dir, "ex")
    return rounded(ms.match_search(iv, ex, F.expr("(i + j) % 3 = 0"), 100, (4.0, 8.0), (0.0, 0.1), (1.2, 2.0)), "f1")


@query("""SELECT name, place::INT AS place FROM (SELECT s_name AS name, row_number() OVER (ORDER BY s_suppkey % 3 DESC, s_suppkey % 4 DESC, s_nationkey, s_name) AS place FROM supplier WHERE s_acctbal > 0)""")
def config_ranking(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("accepted"), (F.col("s_suppkey") % 3).alias("full"), (F.col("s_suppkey") % 4).alias("f1"), F.col("s_nationkey").alias("kept_wrong"))
    return ms.rank_configs(rows).select("name", "place")


@query("""WITH t AS (SELECT * FROM (SELECT p_brand AS source, p_partkey AS setting, p_retailprice AS pq, p_size % 2 AS side, row_number() OVER (PARTITION BY p_size % 2, p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 2)
SELECT a.setting AS iv_setting, b.setting AS ex_setting, round(a.pq + b.pq, 6) AS total FROM t a JOIN t b ON a.side = 0 AND b.side = 1""")
def setting_pairs(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("setting"), F.col("p_retailprice").alias("pq"), (F.col("p_size") % 2).alias("side"))
    return rounded(ms.best_pair_of_settings(p.where("side = 0"), p.where("side = 1")).select("iv_setting", "ex_setting", "total"), "total")


@query("SELECT c_mktsegment, round(count(*) * count(DISTINCT c_nationkey) / (200.0::DOUBLE * 100) * pi() * 25, 6) AS expected FROM customer GROUP BY ALL")
def expected_random(spark, sf_dir):
    from tessera.operators.points import expected_random as chance

    c = ad.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("m"))
    return rounded(c.select("c_mktsegment", chance(F.col("n"), F.col("m"), F.lit(200.0), F.lit(100.0), 5.0).alias("expected")), "expected")


@query(f"WITH {GATES_SQL}, f AS (SELECT DISTINCT subject AS fold FROM gates) SELECT sample_id, fold, subject = fold AS held_out FROM gates, f")
def leave_one_out_folds(spark, sf_dir):
    r = ad.gate_regions(spark, sf_dir)
    return ms.leave_one_out(r, r).select("sample_id", "fold", "held_out")


# ---------------------------------------------------------------- results


@query("""WITH a AS (SELECT 'c' || (o_custkey % 50) AS sample_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL), b AS (SELECT 'c' || (o_custkey % 50) AS sample_id, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL), s AS (SELECT DISTINCT 'c' || (o_custkey % 50) AS sample_id FROM orders)
SELECT sample_id, coalesce(a.n, 0)::BIGINT AS "before", coalesce(b.n, 0)::BIGINT AS "after", coalesce(a.n, 0) = 0 AND coalesce(b.n, 0) >= 1 AS newly_unlocked FROM s LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id)""")
def unlock_table(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("sample_id"), "o_orderstatus", "o_totalprice")
    base = o.groupBy("sample_id").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n_pairs"))
    return ms.unlock_table(base, o.where("o_totalprice > 300000").groupBy("sample_id").agg(F.count("*").alias("n_pairs")))


_RESULTS = "p{m} AS (SELECT DISTINCT 'c' || (o_custkey % 50) AS sample_id, (o_orderkey % {m})::VARCHAR AS iv_id, (o_custkey % 89)::VARCHAR AS ex_id FROM orders)"


@query(f"WITH {_RESULTS.format(m=97)}, {_RESULTS.format(m=83)}, u AS (SELECT *, 1 AS a, 0 AS b FROM p97 UNION ALL SELECT *, 0, 1 FROM p83), g AS (SELECT sample_id, iv_id, ex_id, max(a) AS a, max(b) AS b FROM u GROUP BY ALL) SELECT sample_id, count(*) FILTER (b = 0) AS only_a, count(*) FILTER (a = 0) AS only_b, count(*) FILTER (a = 1 AND b = 1) AS common FROM g GROUP BY ALL")
def result_diff(spark, sf_dir):
    return ms.result_diff(ad.result_pairs(spark, sf_dir), ad.result_pairs(spark, sf_dir, 83), ["sample_id"])


@query("WITH p AS (SELECT 'c' || (o_custkey % 50) AS sample_id, (o_orderkey % 97)::VARCHAR AS iv_id, (o_custkey % 89)::VARCHAR AS ex_id FROM orders) SELECT sample_id, 'iv_id' AS side, iv_id AS id, count(*) AS uses FROM p GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT sample_id, 'ex_id', ex_id, count(*) FROM p GROUP BY ALL HAVING count(*) > 1")
def one_to_one_checks(spark, sf_dir):
    return ms.one_to_one_errors(ad.result_pairs(spark, sf_dir))


@query("""WITH p AS (SELECT 'c' || (o_custkey % 50) AS sample_id, (o_orderkey % 97)::VARCHAR AS iv_id, (o_custkey % 89)::VARCHAR AS ex_id FROM orders), m AS (SELECT DISTINCT sample_id, 'invivo' AS modality, iv_id AS cell_id FROM p UNION ALL SELECT DISTINCT sample_id, 'exvivo', ex_id FROM p),
i AS (SELECT 'c' || (c_custkey % 50) AS sample_id, CASE WHEN c_custkey % 2 = 0 THEN 'invivo' ELSE 'exvivo' END AS modality, (c_custkey % 89)::VARCHAR AS cell_id FROM customer) SELECT * FROM m ANTI JOIN i USING (sample_id, modality, cell_id)""")
def fk_checks(spark, sf_dir):
    k = F.col("c_custkey")
    cells = ad.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), (k % 50).cast("string")).alias("sample_id"), F.when(k % 2 == 0, "invivo").otherwise("exvivo").alias("modality"), (k % 89).cast("string").alias("cell_id"))
    return ms.missing_ids(ad.result_pairs(spark, sf_dir), cells)


@query("SELECT c_name AS sample_id, split_part(c_name, '#', 1) AS head, printf('iv_%06d', c_custkey) AS cell_id FROM customer")
def cell_names(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    return c.select(F.col("c_name").alias("sample_id"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"), g.cell_name("iv", F.col("c_custkey")).alias("cell_id"))


# ---------------------------------------------------------------- iterative and learned (no SQL form)


@query(f"""WITH RECURSIVE {PAIRS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY prob DESC, k) AS r FROM prs WHERE prob >= 0.05),
w AS (SELECT DISTINCT sample_id, 0::BIGINT AS r, []::BIGINT[] AS rows_used, []::BIGINT[] AS cols_used, false AS taken FROM o
  UNION ALL SELECT sample_id, r, CASE WHEN free THEN list_append(rows_used, i) ELSE rows_used END, CASE WHEN free THEN list_append(cols_used, j) ELSE cols_used END, free
  FROM (SELECT o.*, rows_used, cols_used, NOT list_contains(rows_used, o.i) AND NOT list_contains(cols_used, o.j) AS free FROM w JOIN o ON o.sample_id = w.sample_id AND o.r = w.r + 1))
SELECT sample_id, k, i, j, prob FROM o JOIN w USING (sample_id, r) WHERE taken""")
def greedy_rounds(spark, sf_dir):
    from tessera.plans.stages import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return mt.greedy_pairs(ad.scored_pairs(spark, sf_dir).select("sample_id", "k", "i", "j", "prob"), 0.05)


def _own_candidates(spark, sf_dir, method, **options):
    return rg.candidates(ad.points(spark, sf_dir, "iv"), ad.points(spark, sf_dir, "ex"), method, **options)


@query()
def hough_register(spark, sf_dir):
    return rounded(_own_candidates(spark, sf_dir, "hough", keep=5), "score", *g.POSE, "angle", "land_x", "land_y")


@query()
def register_with_priors(spark, sf_dir):
    return rounded(_own_candidates(spark, sf_dir, "priors", keep=3), "score", *g.POSE, "angle", "land_x", "land_y")


@query()
def register_ncc(spark, sf_dir):
    return rounded(_own_candidates(spark, sf_dir, "ncc", keep=3), "score", *g.POSE, "angle", "land_x", "land_y")


@query()
def rematch(spark, sf_dir):
    iv = ad.points(spark, sf_dir, "iv").withColumns({"ox": F.lit(10.0), "oy": F.lit(20.0)})
    ex = ad.points(spark, sf_dir, "ex")
    own = rg.candidates(iv.drop("subject"), ex, "hough", keep=8)
    poses = rm.chosen_poses(iv, ex, own, angle_win=1.0)
    return rounded(rm.matched(iv, ex, poses, least_margin=0.0), "d")


@query()
def joint_icm(spark, sf_dir):
    c = mt.margins(ad.candidates(spark, sf_dir), "score", "soft_margin").withColumn("soft", F.col("score"))
    c = mt.top_list(c, 6).select("subject", "sample_id", "cand_idx", "soft", "soft_margin", *[F.col("pose")[n].alias(n) for n in "abcd"], "land_x", "land_y", "ox", "oy")
    return kernels.joint_groups(c, "subject", 5.0)


@query()
def verifier_loo(spark, sf_dir):
    c = mt.margins(ad.candidates(spark, sf_dir), "score", "margin")
    rows = c.select("subject", "sample_id", "cand_idx", "score", "z", "margin", F.when(F.col("cand_idx") % 9 > 0, (F.col("z") + F.col("score") / 20 > 1.2).cast("int")).alias("y"))
    return rounded(learn.leave_one_out(rows, ["score", "z", "margin"]).select("sample_id", "cand_idx", "prob"), "prob")


@query()
def pair_classifier_loo(spark, sf_dir):
    from tessera.plans.catalog_points import _PAIR_FEATURES, pair_features

    rows = pair_features(spark, sf_dir).withColumns({"subject": g.subject(F.col("sample_id")), "y": (F.col("d") + F.col("iv_contrast") < 5).cast("int")})
    out = learn.leave_one_out(rows, _PAIR_FEATURES, estimator=lambda f, n: learn.trees(f, n, rounds=5))
    return rounded(out.select("sample_id", "i", "j", "prob"), "prob")
