"""Queries on the held-out run: all selections on one table of edges, the verifier on its eight features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import choices as ch
from tessera.operators import heldout as ho
from tessera.operators import learn
from tessera.plans import adapters as ad
from tessera.plans.adapters import rounded
from tessera.plans.builds import Build
from tessera.plans.catalog_choices import _FIT, _truth
from tessera.plans.stages import ensure_checkpoint_dir

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_DISTANCES = (4, 6, 8, 12, 20)
_FIXED = {"given": ad.POSE, "none": (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)}


@query(f"""WITH {_FIT}, fx(selection, a, b, tx, c, d, ty) AS (VALUES {', '.join(f"('{n}', " + ', '.join(f'{v}::DOUBLE' for v in p) + ')' for n, p in _FIXED.items())}),
sl AS (SELECT selection, sample_id, a, b, tx, c, d, ty FROM fx, (SELECT DISTINCT sample_id FROM iv) UNION ALL SELECT 'oracle', sample_id, a, b, mgx - a * mx - b * my, c, d, mgy - c * mx - d * my FROM ft WHERE isfinite(a)),
mv AS (SELECT selection, sample_id, idx, a * x + b * y + tx AS x, c * x + d * y + ty AS y FROM iv JOIN sl USING (sample_id)),
ed AS (SELECT selection, sample_id, m.idx AS i, e.idx AS j, sqrt((m.x - e.x) * (m.x - e.x) + (m.y - e.y) * (m.y - e.y)) AS d FROM mv m JOIN ex e USING (sample_id)),
ds AS (SELECT unnest({list(_DISTANCES)}) AS distance), sp AS (SELECT distance, ed.*, tr.i IS NOT NULL AS good FROM ed JOIN ds ON d < distance LEFT JOIN tr USING (sample_id, i, j)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY selection, distance, sample_id, i ORDER BY d, j) AS r FROM sp), n2 AS (SELECT *, row_number() OVER (PARTITION BY selection, distance, sample_id, j ORDER BY d, i) AS q FROM n1 WHERE r = 1),
ct AS (SELECT selection, distance, count(*) FILTER (good) AS tp, count(*) AS pred FROM n2 WHERE q = 1 GROUP BY ALL), el AS (SELECT selection, distance, count(*) FILTER (good) AS eligible FROM sp GROUP BY ALL),
ot AS (SELECT selection, distance::DOUBLE AS distance, eligible, tp, pred - tp AS fp, (SELECT count(*) FROM tr) - tp AS fn, 2.0 * tp / (pred + (SELECT count(*) FROM tr)) AS f1 FROM ct JOIN el USING (selection, distance))
SELECT selection, distance, eligible, tp, fp, fn, round(f1, 6) AS f1, row_number() OVER (ORDER BY round(f1, 9) DESC, selection, distance)::INT AS place FROM ot""")
def heldout_run(spark, sf_dir):
    """The given pose, none, and the oracle's upper bound, at five distances."""
    iv, truth = ad.points(spark, sf_dir, "iv"), _truth(spark, sf_dir)
    listed = F.array(*[F.struct(F.lit(n).alias("selection"), *[F.lit(v).alias(c) for c, v in zip(g.POSE, p)]) for n, p in _FIXED.items()])
    fixed = iv.select("sample_id").distinct().select("sample_id", F.inline(listed)).select(*ho.SELECTION)
    selections = fixed.unionByName(ho.oracle(truth))
    return rounded(ho.heldout_run(iv, ad.points(spark, sf_dir, "ex"), truth, selections, _DISTANCES), "f1")


@query()
def verifier_loo_whole(spark, sf_dir):
    """The verifier on all eight features of its table; twentieths of a field's candidates are its regions here."""
    c = ad.candidates(spark, sf_dir).withColumns({"soft": F.col("score"), "sample_id": F.concat("sample_id", F.lit("."), F.col("cand_idx") % 20)})
    table = ch.verifier_table(c, ["subject"])
    features = ["soft", "soft_margin", "z", "refine_margin", "landing_dist", "angle", "scale", "anisotropy"]
    ensure_checkpoint_dir(spark)
    rows = table.withColumn("y", F.when(F.col("cand_idx") % 9 > 0, (F.col("z") + F.col("soft") / 20 > 2.4).cast("int"))).checkpoint()  # every fold reads it
    return rounded(learn.leave_one_out(rows, features).select("sample_id", "cand_idx", "v10", "prob"), "prob")


@query("""WITH t AS (SELECT c_nationkey AS nation, n_regionkey AS region, sum(c_acctbal::DOUBLE + CASE WHEN c_nationkey = 3 THEN 1000000 ELSE 0 END) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT nation, region, round(total / max(total) OVER (PARTITION BY region), 6) + 0.0 AS share, 1::BIGINT AS nations_again, 1::BIGINT AS regions_again, (SELECT count(*) FROM t a JOIN t b USING (region) WHERE a.nation = 3) AS shares_again FROM t""")
def incremental_build(spark, sf_dir):
    """Nations, their regions and the nations' shares, built twice; between the runs one nation's customers change, and only it,
    its region and the shares of that region are computed again."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/build-{uuid.uuid4().hex}"
    c = ad.table(spark, sf_dir, "customer").join(F.broadcast(ad.table(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))  # 25 nations
    for more in (0.0, 1_000_000.0):
        rows = c.select(F.col("c_nationkey").cast("int").alias("nation"), F.col("n_regionkey").cast("int").alias("region"), "c_custkey", (F.col("c_acctbal").cast("double") + F.when(F.col("c_nationkey") == 3, more).otherwise(0.0)).alias("v"))
        build = Build(spark, root)
        nations = build.step("nations", rows, ["nation"], lambda x: x.groupBy("nation").agg(F.first("region").alias("region"), F.sum("v").alias("total")))
        regions = build.step("regions", nations, ["region"], lambda x: x.groupBy("region").agg(F.max("total").alias("most")))
        shares = build.step("shares", nations.join(regions, "region"), ["nation"], lambda x: x.select("nation", "region", (F.col("total") / F.col("most")).alias("share")))
    again = [F.lit(build.work[s]).cast("long").alias(f"{s}_again") for s in ("nations", "regions", "shares")]
    return rounded(shares.select("nation", "region", "share", *again), "share")
