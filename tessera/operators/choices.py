"""Choices over settings: lambda by left-out subjects, verifier tables, stretch hypotheses, merged candidates, sweeps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import consensus as cs
from tessera.operators import kernels
from tessera.operators import matching as mt
from tessera.operators.candidates import STRETCHES

# Support shares of a second mode, and bounds of duplicate poses (linear part, pixels).
MODE_CUTS, DUP_LINEAR, DUP_TRANSLATION = (0.45, 0.30, 0.20, 0.10), 0.01, 4.0


def best_setting_without(counts: DataFrame, setting: str, group: str = "subject", value: str = "n") -> DataFrame:
    """For every group the setting of largest sum over the other groups, ties to the smaller one (O129).

    ``counts``: setting, group, value, a row each.  What the others sum to is the total less the own value, so
    groups are not joined with each other.
    """
    total = counts.groupBy(setting).agg(F.sum(value).alias("_total"))
    groups = counts.select(group).distinct()
    every = groups.crossJoin(F.broadcast(total)).join(counts, [group, setting], "left")  # settings are a parameter list
    rest = every.withColumn("_rest", F.col("_total") - F.coalesce(value, F.lit(0)))
    order = Window.partitionBy(group).orderBy(F.desc("_rest"), setting)
    return rest.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(group, setting, F.coalesce(value, F.lit(0)).alias("own"), F.col("_rest").alias("others"))


def verifier_table(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The eight features of each sample's best candidate, with its gate (O131): soft, soft_margin, z, refine_margin,
    landing_dist, angle, scale, anisotropy.

    ``candidates``: keys, sample_id, cand_idx, soft, score, z, angle, land_x, land_y, pose; non-finite values
    become null.
    """
    marked = mt.margins(mt.margins(candidates, "soft", "soft_margin"), "score", "refine_margin")
    best = mt.top_list(marked, 1).drop("place")
    dist = cs.landing_distance(best, keys).select("sample_id", F.col("dist").alias("landing_dist"))
    out = best.join(dist, "sample_id").withColumns({"scale": g.scale(F.col("pose")), "anisotropy": g.anisotropy(F.col("pose"))})
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c)
    names = ("soft", "soft_margin", "z", "refine_margin", "landing_dist", "angle", "scale", "anisotropy")
    return out.select(*keys, "sample_id", "cand_idx", *[finite(n) for n in names], mt.evidence_gate(F.col("refine_margin"), F.col("z")).alias("v10"))


def stretch_matrix(factor: Column, direction: Column) -> Column:
    """Stretch by a factor along a direction in degrees, as a pose struct."""
    ux, uy, k = F.cos(F.radians(direction)), F.sin(F.radians(direction)), factor - 1
    zero = F.lit(0.0)
    return F.struct((1 + k * ux * ux).alias("a"), (k * ux * uy).alias("b"), zero.alias("tx"), (k * ux * uy).alias("c"), (1 + k * uy * uy).alias("d"), zero.alias("ty"))


def stretched_sources(points: DataFrame, stretches=STRETCHES) -> DataFrame:
    """The points once a hypothesis (O96, O210): adds hypothesis, stretch, direction; x and y are stretched."""
    listed = F.array(*[F.struct(F.lit(i).alias("hypothesis"), F.lit(float(k)).alias("stretch"), F.lit(float(p)).alias("direction")) for i, (k, p) in enumerate(stretches)])
    rows = points.select("*", F.inline(listed))
    m, x, y = stretch_matrix(F.col("stretch"), F.col("direction")), F.col("x"), F.col("y")
    return rows.withColumns({"x": g.move_x(m, x, y), "y": g.move_y(m, x, y)})


def unstretched(candidates: DataFrame) -> DataFrame:
    """Poses found for stretched points, as poses of the points themselves (O108)."""
    return candidates.withColumn("pose", g.compose(F.col("pose"), stretch_matrix(F.col("stretch"), F.col("direction"))))


def best_hypothesis(candidates: DataFrame) -> DataFrame:
    """The best candidate of each sample over all hypotheses, in the true frame; ties to the earlier hypothesis."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), "hypothesis", "cand_idx")
    return unstretched(candidates).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def deduplicated(candidates: DataFrame, lin_tol: float = DUP_LINEAR, t_tol: float = DUP_TRANSLATION) -> DataFrame:
    """Candidates by descending ``soft`` (ties to the earlier source, then index) without those whose linear part and
    translation a kept one has within the tolerances (O106).  ``candidates``: sample_id, source_rank, cand_idx, soft, pose."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["soft", "source_rank", "cand_idx"], ascending=[False, True, True]).reset_index(drop=True)
        linear, shift = t[["a", "b", "c", "d"]].to_numpy(float), t[["tx", "ty"]].to_numpy(float)
        keep = kernels.apart(linear, shift, lin_tol, t_tol)
        return t.loc[keep, ["sample_id", "source_rank", "cand_idx", "soft"]].assign(place=range(1, len(keep) + 1))

    rows = candidates.select("sample_id", "source_rank", "cand_idx", "soft", *[F.col("pose")[n].alias(n) for n in g.POSE])
    return rows.groupBy("sample_id").applyInPandas(run, "sample_id string, source_rank int, cand_idx long, soft double, place int")


def mode_cut_sweep(candidates: DataFrame, keys: list[str], cuts=MODE_CUTS) -> DataFrame:
    """Modes a group under every support share that a second mode must have (O86), from one search."""
    modes = cs.vote_modes(candidates, keys, second_share=0.0)
    by = modes.groupBy(*keys).agg(F.max(F.when(F.col("mode_idx") == 0, F.col("support"))).alias("_a"), F.max(F.when(F.col("mode_idx") == 1, F.col("support"))).alias("_b"))
    rows = by.select(*keys, "_a", "_b", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"))
    return rows.select("cut", *keys, (1 + F.coalesce((F.col("_b") >= F.col("cut") * F.col("_a")).cast("int"), F.lit(0))).alias("modes"), "_a").withColumnRenamed("_a", "support")


def inside_windows(poses: DataFrame, modes: DataFrame, keys: list[str], angle_win: float = 5.0, radius: float = 120.0) -> DataFrame:
    """Whether a sample's pose lies in the window of its group's nearest mode by angle, then landing (O215).
    ``poses``: keys, sample_id, angle, land_x, land_y; ``modes``: keys, angle, land_x, land_y (two at most)."""
    m = modes.select(*keys, F.col("angle").alias("_a"), F.col("land_x").alias("_x"), F.col("land_y").alias("_y"))
    d = F.struct(F.abs(F.col("angle") - F.col("_a")).alias("angle"), g.distance(F.col("land_x"), F.col("land_y"), F.col("_x"), F.col("_y")).alias("landing"))
    near = poses.join(m, keys).groupBy(*keys, "sample_id").agg(F.min(d).alias("_d"))
    return near.select(*keys, "sample_id", F.col("_d.angle").alias("d_angle"), F.col("_d.landing").alias("d_landing"), ((F.col("_d.angle") <= angle_win) & (F.col("_d.landing") <= radius)).alias("inside"))


def gap_to_best(candidates: DataFrame, score: str = "score") -> DataFrame:
    """Adds the place of a candidate in its sample and its gap to the best score (O146)."""
    w = Window.partitionBy("sample_id")
    return candidates.withColumns({"place": F.row_number().over(w.orderBy(F.desc(score), "cand_idx")), "gap": F.max(score).over(w) - F.col(score)})


def overlay(base: DataFrame, settings: DataFrame, choice: DataFrame, values: list[str]) -> DataFrame:
    """Records with each subject's chosen setting laid over the baseline (O199).  ``base``: subject, sample_id, values;
    ``settings``: sample_id, setting, values; ``choice``: subject, setting (null or absent: baseline)."""
    new = settings.select("sample_id", "setting", *[F.col(v).alias(f"_{v}") for v in values])
    rows = base.join(choice, "subject", "left").join(new, ["sample_id", "setting"], "left")
    return rows.select("subject", "sample_id", F.when(F.col(f"_{values[0]}").isNotNull(), F.col("setting")).alias("setting"), *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def affine_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares affine pose of matched points (x, y) -> (gx, gy) by their moments, null where the points lie on a
    line (O192, O209): keys, n, pose columns."""
    mean = Window.partitionBy(*keys)
    at = {c: F.col(c) - F.avg(c).over(mean) for c in ("x", "y", "gx", "gy")}
    rows = pairs.select(*keys, "x", "y", "gx", "gy", *[v.alias(f"_{c}") for c, v in at.items()])
    s = lambda a, b: F.sum(F.col(f"_{a}") * F.col(f"_{b}"))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"_m{c}") for c in ("x", "y", "gx", "gy")],
        *[s(a, b).alias(f"_{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "gx"), ("y", "gx"), ("x", "gy"), ("y", "gy"))],
    )
    c = F.col
    det = c("_xx") * c("_yy") - c("_xy") * c("_xy")
    solve = lambda u, v, side: F.when((c("n") >= 3) & (det > 1e-9 * (c("_xx") * c("_yy") + 1e-12)), (u * c("_yy") - v * c("_xy") if side == 0 else v * c("_xx") - u * c("_xy")) / det)
    out = sums.withColumns({"a": solve(c("_xgx"), c("_ygx"), 0), "b": solve(c("_xgx"), c("_ygx"), 1), "c": solve(c("_xgy"), c("_ygy"), 0), "d": solve(c("_xgy"), c("_ygy"), 1)})
    out = out.withColumns({"tx": c("_mgx") - c("a") * c("_mx") - c("b") * c("_my"), "ty": c("_mgy") - c("c") * c("_mx") - c("d") * c("_my")})
    return out.select(*keys, "n", *g.POSE)
