"""Decisions of a group of samples: orientation, consistency gate, vote modes, duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import blocks
from tessera.plans.stages import ensure_checkpoint_dir

# Fixed value: mean place of in-vivo fields on the ex-vivo canvas, as shares of width and height.
FIELD_PRIOR = (0.48, 0.54)


def subject_modes(regions: DataFrame, share: float = 0.65) -> DataFrame:
    """``regions``: subject, h, w, score_0, score_1.  0 or 1 where the subject's canvases are mostly square
    and most regions prefer that orientation, else null (O83)."""
    square = F.avg((F.abs(F.log(F.col("h") / F.col("w"))) < 0.1).cast("double"))
    first = F.avg((F.col("score_0") > F.col("score_1")).cast("double"))
    by = regions.groupBy("subject").agg(square.alias("s"), first.alias("p"))
    mode = F.when((F.col("s") >= share) & (F.col("p") >= share), 0).when((F.col("s") >= share) & (1 - F.col("p") >= share), 1)
    return by.select("subject", mode.cast("int").alias("mode"))


def consistent_regions(centres: DataFrame, gate: float) -> DataFrame:
    """``centres``: subject, sample_id, cx, cy (shares of the canvas).  Keeps regions within ``gate`` of the
    anchor: the median of the neighbours of the region with most neighbours (O26, O84)."""
    return consistent_by_gate(centres, ["subject"], [gate]).drop("gate")


def consistent_by_gate(centres: DataFrame, keys: list[str], gates: list[float]) -> DataFrame:
    """The same for several gates in one plan: gate, keys, sample_id."""
    shares = [float(x) for x in gates]

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, u, v = (t[c].to_numpy(float) for t in (a, b) for c in ("cx", "cy"))
        ones, parts = np.ones(len(b)), []
        for gate in shares if len(b) else ():
            near = lambda i, j: np.sqrt((x[i, None] - u[j]) ** 2 + (y[i, None] - v[j]) ** 2) <= gate  # noqa: E731, B023
            parts.append(a[[*keys, "sample_id", "cx", "cy"]].assign(gate=gate, n=blocks.summed(near, ones, len(a), len(b)).astype(int)))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*keys, "sample_id", "cx", "cy", "gate", "n"])

    by = ["gate", *keys]
    rows = centres.select(*keys, "sample_id", "cx", "cy")
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in rows.columns) + ", gate double, n long"
    seen = blocks.compare(rows, rows.drop("sample_id").withColumn("_t", F.xxhash64("cx", "cy")), keys, ("sample_id", "_t"), count, schema)
    seen = seen.groupBy(*by, "sample_id", "cx", "cy").agg(F.sum("n").alias("n")).where("n > 0")
    prior = g.distance(F.col("cx"), F.col("cy"), F.lit(FIELD_PRIOR[0]), F.lit(FIELD_PRIOR[1]))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), prior, "sample_id")
    first = seen.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*by, F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    # medians of the anchor's neighbours alone
    around = rows.join(first, keys).where(g.distance(F.col("_x"), F.col("_y"), F.col("cx"), F.col("cy")) <= F.col("gate"))
    anchor = around.groupBy(*by).agg(F.percentile("cx", F.lit(0.5)).alias("mx"), F.percentile("cy", F.lit(0.5)).alias("my"))
    return rows.join(anchor, keys).where(g.distance(F.col("cx"), F.col("cy"), F.col("mx"), F.col("my")) <= F.col("gate")).select(*by, "sample_id")


def normalised(candidates: DataFrame) -> DataFrame:
    """Adds z: score minus the sample's median over its (population) deviation, at least 0."""
    by = candidates.groupBy("sample_id").agg(F.percentile("score", F.lit(0.5)).alias("_m"), F.stddev_pop("score").alias("_s"))
    return candidates.join(by, "sample_id").withColumn("z", F.greatest((F.col("score") - F.col("_m")) / (F.col("_s") + 1e-6), F.lit(0.0))).drop("_m", "_s")


def _round(voters: DataFrame, centres: DataFrame, keys: list[str], angle_tol: float, land_tol: float, mode: int) -> tuple[DataFrame, DataFrame]:
    """Best centre of one round: (mode row, members)."""
    names = ["angle", "land_x", "land_y"]

    def best_values(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Of each voting sample the best z near each centre of the block."""
        parts, (p, x, y) = [], (a[c].to_numpy(float) for c in ("_a", "_x", "_y"))
        for sample, own in b.sort_values("z", ascending=False).groupby("sample_id") if len(a) else ():
            q, u, v = (own[c].to_numpy(float) for c in names)
            near = lambda i, j: (np.abs(q[j] - p[i, None]) < angle_tol) & (np.sqrt((u[j] - x[i, None]) ** 2 + (v[j] - y[i, None]) ** 2) < land_tol)  # noqa: E731, B023
            found = blocks.first_values(near, own.z.to_numpy(float), len(a))
            parts.append(a[[*keys, "_s", "_c"]].assign(sample_id=sample, z=found)[np.isfinite(found)])
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*keys, "_s", "_c", "sample_id", "z"])

    c = centres.select(*keys, F.col("sample_id").alias("_s"), F.col("cand_idx").alias("_c"), F.col("angle").alias("_a"), F.col("land_x").alias("_x"), F.col("land_y").alias("_y"))
    rows = voters.select(*keys, "sample_id", "cand_idx", "z", *names)
    types = dict(c.dtypes) | dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in [*keys, "_s", "_c", "sample_id"]) + ", z double"
    met = blocks.compare(c, rows, keys, ("_c", "cand_idx"), best_values, schema)
    met = met.groupBy(*keys, "_s", "_c", "sample_id").agg(F.max("z").alias("z"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("sample_id", "z"))), F.lit(0.0), lambda s, v: s + v["z"])
    support = met.groupBy(*keys, "_s", "_c").agg(total.alias("support"), F.count_if(F.col("z") > 0).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("support"), "_s", "_c")
    best = support.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").join(c, [*keys, "_s", "_c"])
    # the members of the best centre alone: one row a sample
    near = (F.abs(F.col("angle") - F.col("_a")) < angle_tol) & (g.distance(F.col("land_x"), F.col("land_y"), F.col("_x"), F.col("_y")) < land_tol)
    inside = rows.join(best, keys).where(near & (F.col("z") > 0))
    members = inside.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "sample_id").orderBy(F.desc("z"), "cand_idx"))).where("_k = 1")
    ensure_checkpoint_dir(voters.sparkSession)
    members = members.checkpoint()  # a row a sample; the next round starts from it
    row = members.groupBy(*keys, "support", "n").agg(F.percentile("angle", F.lit(0.5)).alias("angle"), F.percentile("land_x", F.lit(0.5)).alias("land_x"), F.percentile("land_y", F.lit(0.5)).alias("land_y"))
    return row.withColumn("mode_idx", F.lit(mode)), members.select(*keys, "sample_id")


def vote_modes(candidates: DataFrame, keys: list[str], angle_tol: float = 3.0, land_tol: float = 70.0, second_share: float = 0.45) -> DataFrame:
    """Up to two consensus poses a group (O85): the centre with the largest sum over samples of the best
    normalised score in tolerance; the second from samples that did not support the first, with at least
    two members and ``second_share`` of the first's support.

    ``candidates``: keys, sample_id, cand_idx, score, angle, land_x, land_y.  Rounds are unrolled.
    """
    scored = normalised(candidates)
    one, members = _round(scored, scored, keys, angle_tol, land_tol, 0)
    one = one.where("n >= 2")
    kept = members.join(one.select(*keys), keys, "left_semi")
    two, _ = _round(scored.join(kept, [*keys, "sample_id"], "left_anti"), scored, keys, angle_tol, land_tol, 1)
    first = one.select(*keys, F.col("support").alias("_first"))
    two = two.join(first, keys).where((F.col("n") >= 2) & (F.col("support") >= second_share * F.col("_first"))).drop("_first")
    return one.unionByName(two).select(*keys, "mode_idx", "angle", "land_x", "land_y", "support", "n")


def cluster_modes(poses: DataFrame, keys: list[str], angle_tol: float = 4.0, land_tol: float = 120.0, modes: int = 2, least_share: float = 0.25) -> DataFrame:
    """Densest weighted clusters, strongest first, members removed between rounds.

    ``poses``: keys, idx, weight, angle, land_x, land_y.
    """

    def weigh(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Weight of the part's poses near each pose of the block."""
        (p, x, y), (q, u, v) = ([t[c].to_numpy(float) for c in ("angle", "land_x", "land_y")] for t in (a, b))
        near = lambda i, j: (np.abs(q[j] - p[i, None]) <= angle_tol) & (np.sqrt((u[j] - x[i, None]) ** 2 + (v[j] - y[i, None]) ** 2) <= land_tol)
        return a[[*keys, "idx"]].assign(w=blocks.summed(near, b.weight.to_numpy(float), len(a), len(b)))

    ensure_checkpoint_dir(poses.sparkSession)
    types = dict(poses.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "idx"]) + ", w double"
    out, left, total = None, poses, poses.groupBy(*keys).agg(F.sum("weight").alias("_total"))
    for mode in range(modes):
        weight = blocks.compare(left, left, keys, ("idx", "idx"), weigh, schema).groupBy(*keys, "idx").agg(F.sum("w").alias("w"))
        best = weight.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "idx"))).where("_k = 1").drop("_k")
        best = best.join(total, keys).where(F.col("w") >= least_share * F.col("_total")).drop("_total")
        c = best.join(left, [*keys, "idx"]).select(*keys, "w", F.col("angle").alias("_a"), F.col("land_x").alias("_x"), F.col("land_y").alias("_y"))
        near = (F.abs(F.col("angle") - F.col("_a")) <= angle_tol) & (g.distance(F.col("land_x"), F.col("land_y"), F.col("_x"), F.col("_y")) <= land_tol)
        members = left.join(c, keys).where(near).checkpoint()  # the next round starts from what is left
        row = members.groupBy(*keys, "w").agg(F.percentile("angle", F.lit(0.5)).alias("angle"), F.percentile("land_x", F.lit(0.5)).alias("land_x"), F.percentile("land_y", F.lit(0.5)).alias("land_y"), F.count("*").alias("n")).withColumn("mode_idx", F.lit(mode))
        out = row if out is None else out.unionByName(row)
        left = left.join(members.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    return out.select(*keys, "mode_idx", "angle", "land_x", "land_y", F.col("w").alias("support"), "n")


def content_key(*columns: str) -> Column:
    """SHA-1 of the values and their place; nulls count."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))


def voters_once(regions: DataFrame, keys: list[str], dup_key: str = "dup_key", pos: str = "pos") -> DataFrame:
    """The first region of each content in a group."""
    order = Window.partitionBy(*keys, dup_key).orderBy(pos)
    return regions.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def scan_inputs(regions: DataFrame) -> DataFrame:
    """Distinct inputs with the samples they cover (O201)."""
    return regions.groupBy("dup_key").agg(F.array_sort(F.collect_list("sample_id")).alias("sample_ids"), F.count("*").alias("n"))


def _median_of_others(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds to every row the median of ``value`` over the other rows of its group (null if alone): the middle of the
    sorted group, moved by one place for rows that stand before it."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(value, "sample_id")), "_n": F.count("*").over(w)})
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(value)))
    # without one row, n - 1 values have their middle at these places of the whole order
    low, high = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)
    middle = ranked.where(F.col("_r").between(low, high + 1)).groupBy(*keys).agg(at(low).alias("_a"), at(low + 1).alias("_b"), at(high).alias("_c"), at(high + 1).alias("_d"))
    first = F.when(F.col("_r") <= low, F.col("_b")).otherwise(F.col("_a"))
    second = F.when(F.col("_r") <= high, F.col("_d")).otherwise(F.col("_c"))
    found = ranked.join(middle, keys).withColumn(out, F.when(F.col("_n") > 1, (first + second) / 2))
    return found.drop("_r", "_n", "_a", "_b", "_c", "_d")


def landing_distance(poses: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of a sample's landing to the median of the group's others; 0 if alone (O130)."""
    rows = _median_of_others(poses.select(*keys, "sample_id", "land_x", "land_y"), keys, "land_x", "_mx")
    rows = _median_of_others(rows, keys, "land_y", "_my")
    d = g.distance(F.col("land_x"), F.col("land_y"), F.col("_mx"), F.col("_my"))
    return rows.select(*keys, "sample_id", F.coalesce(d, F.lit(0.0)).alias("dist"))


def linear_priors(fits: DataFrame) -> DataFrame:
    """Medians of plausible linear parts, by sign of the rotation (O98).  ``fits``: subject, pose."""
    m = F.col("pose")
    ok = fits.where((F.abs(g.det(m)) > 0.65) & (F.abs(g.det(m)) < 1.3))
    side = F.when(F.atan2(m["c"], m["a"]) >= 0, 0).otherwise(1).alias("cluster")
    return ok.groupBy(side).agg(*[F.percentile(m[n], F.lit(0.5)).alias(n) for n in ("a", "b", "c", "d")], F.count("*").alias("n"))



def volume_modes(candidates: DataFrame, keys: list[str], angle_bin: float = 3.0, land_bin: float = 60.0, apart: float = 9.0) -> DataFrame:
    """Peaks of the summed score volume over (angle, landing) bins of a group: the fullest bin, and the fullest
    of those more than ``apart`` degrees from it (O88).  A sample adds its best score to a bin once."""
    cell = lambda c, w: F.floor(F.col(c) / w)
    bins = {"ba": cell("angle", angle_bin), "bx": cell("land_x", land_bin), "by": cell("land_y", land_bin)}
    best = candidates.withColumns(bins).groupBy(*keys, "sample_id", *bins).agg(F.max("score").alias("score"))
    volume = best.groupBy(*keys, *bins).agg(F.sum("score").alias("support"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("support"), *bins)
    first = volume.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    far = volume.join(first.select(*keys, F.col("ba").alias("_ba")), keys).where(F.abs(F.col("ba") - F.col("_ba")) * angle_bin > apart).drop("_ba")
    second = far.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return first.withColumn("mode_idx", F.lit(0)).unionByName(second.withColumn("mode_idx", F.lit(1)))


def volume_variants(candidates: DataFrame, keys: list[str], floor: float = 2.0, angle_bin: float = 3.0, land_bin: float = 60.0) -> DataFrame:
    """The fullest bin of a group when normalised scores are summed as they are, above ``floor``, or squared above it (O206)."""
    over = F.greatest(F.col("z") - floor, F.lit(0.0))
    kinds = F.array(*[F.struct(F.lit(n).alias("variant"), v.alias("_w")) for n, v in (("clip0", F.col("z")), ("over", over), ("square", over * over))])
    cell = lambda c, w: F.floor(F.col(c) / w)
    bins = {"ba": cell("angle", angle_bin), "bx": cell("land_x", land_bin), "by": cell("land_y", land_bin)}
    spread = normalised(candidates).withColumns(bins).select(*keys, "sample_id", *bins, F.inline(kinds))
    best = spread.groupBy("variant", *keys, "sample_id", *bins).agg(F.max("_w").alias("_w"))
    volume = best.groupBy("variant", *keys, *bins).agg(F.sum("_w").alias("support"), F.count("*").alias("n"))
    order = Window.partitionBy("variant", *keys).orderBy(F.desc(F.round("support", 9)), *bins)
    return volume.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
