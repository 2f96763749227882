"""Choosing poses and pairs: greedy one-to-one selection, margins, gates, joint-selection terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import blocks


def greedy_pairs(edges: DataFrame, threshold: float, rounds: int = 8) -> DataFrame:
    """One-to-one pairs by descending probability, ties to the lower candidate index (O122).

    ``edges``: sample_id, k, i, j, prob.  An edge that ranks first at both its ends is in the sequential
    result; it is taken, its ends leave, and the rest is ranked again.  Each round is cut by a checkpoint
    (the caller's checkpoint folder), so the plan stays flat.  Long chains of falling probability lose one edge a
    round; what ``rounds`` rounds leave is finished sample by sample in the sequential order.
    """
    order = (F.desc("prob"), F.asc("k"))
    left = edges.where(F.col("prob") >= threshold)
    taken = None
    for _ in range(rounds):
        first = left.withColumn("_i", F.row_number().over(Window.partitionBy("sample_id", "i").orderBy(*order))).withColumn("_j", F.row_number().over(Window.partitionBy("sample_id", "j").orderBy(*order)))
        new = first.where("_i = 1 AND _j = 1").drop("_i", "_j").checkpoint()
        taken = new if taken is None else taken.unionByName(new)
        left = left.join(new.select("sample_id", "i"), ["sample_id", "i"], "left_anti").join(new.select("sample_id", "j"), ["sample_id", "j"], "left_anti").checkpoint()
        if left.isEmpty():
            return taken
    return left.limit(0) if taken is None else taken.unionByName(_in_order(left))


def _in_order(edges: DataFrame) -> DataFrame:
    """The sequential rule on each sample's edges."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["prob", "k"], ascending=[False, True])
        rows, cols, keep = set(), set(), []
        for i, j in zip(g.i, g.j):
            keep.append(i not in rows and j not in cols)
            if keep[-1]:
                rows.add(i)
                cols.add(j)
        return g[keep]

    return edges.groupBy("sample_id").applyInPandas(run, edges.schema)


def additive_pairs(base: DataFrame, more: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Candidates of ``more`` on ends that ``base`` does not use, from ``threshold`` up (O208); not yet one-to-one."""
    free = more.where(F.col("prob") >= threshold)
    return free.join(base.select("sample_id", "i"), ["sample_id", "i"], "left_anti").join(base.select("sample_id", "j"), ["sample_id", "j"], "left_anti")


def margins(candidates: DataFrame, score: str, out: str) -> DataFrame:
    """Score minus the best score of a clearly different candidate of the sample, 0 if none (O52, O124).

    ``candidates``: sample_id, cand_idx, angle, land_x, land_y and the score.  Every candidate goes down its sample's
    scores to the first that differs, which for most stands among the first few.
    """
    names = ["angle", "land_x", "land_y"]

    def rivals(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.dropna(subset=[score]).sort_values(score, ascending=False)
        (p, x, y), (q, u, v) = ([t[c].to_numpy(float) for c in names] for t in (a, b))
        own, other = a.cand_idx.to_numpy(), b.cand_idx.to_numpy()
        differ = lambda i, j: (own[i, None] != other[j]) & ((np.abs(p[i, None] - q[j]) > g.CLEAR_ANGLE) | (np.sqrt((x[i, None] - u[j]) ** 2 + (y[i, None] - v[j]) ** 2) > g.CLEAR_LANDING))
        found = blocks.first_values(differ, b[score].to_numpy(float), len(a))
        return a[["sample_id", "cand_idx"]].assign(_rival=found)[np.isfinite(found)]

    rows = candidates.select("sample_id", "cand_idx", *names, score)
    types = dict(rows.dtypes)
    met = blocks.compare(rows.drop(score), rows, ["sample_id"], ("cand_idx", "cand_idx"), rivals, f"sample_id {types['sample_id']}, cand_idx {types['cand_idx']}, _rival double")
    best = met.groupBy("sample_id", "cand_idx").agg(F.max("_rival").alias("_rival"))
    return candidates.join(best, ["sample_id", "cand_idx"], "left").withColumn(out, F.col(score) - F.coalesce("_rival", F.lit(0.0))).select(*candidates.columns, out)


def choose(candidates: DataFrame, rule: str = "score") -> DataFrame:
    """One candidate a sample by score, z or the sum of both standardised (O123); lowest index on ties."""
    w = Window.partitionBy("sample_id")
    standard = lambda c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-6)
    value = {"score": F.col("score"), "z": F.col("z"), "mix": standard("score") + standard("z")}[rule]
    scored = candidates.withColumn("value", value)
    return scored.withColumn("_k", F.row_number().over(w.orderBy(F.desc("value"), "cand_idx"))).where("_k = 1").drop("_k")


def choose_gated(candidates: DataFrame, gated: Column) -> DataFrame:
    """Gated candidates first, then margin, then score (O207)."""
    order = Window.partitionBy("sample_id").orderBy(F.desc(gated), F.desc("margin"), F.desc("score"), "cand_idx")
    return candidates.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def evidence_gate(margin: Column, z: Column) -> Column:
    """Margin of at least 3 or evidence of at least 5 (O27); null counts as no."""
    return F.coalesce(margin >= 3, F.lit(False)) | F.coalesce(z >= 5, F.lit(False))


def kept(prob: Column, gate: Column, registered: Column, tau: Column) -> Column:
    """Registered and (gate or prob >= tau); without tau the gate alone."""
    return registered & (gate | F.coalesce(prob >= tau, F.lit(False)))


def rerank(candidates: DataFrame, gap: float = 0.03, votes: float = 3.0) -> DataFrame:
    """The candidate of best image score replaces the chosen one where it leads by ``gap`` and the vote score
    loses less than ``votes`` (O125).  ``candidates``: sample_id, cand_idx, score, image, chosen."""
    w = Window.partitionBy("sample_id")
    best = candidates.withColumn("_k", F.row_number().over(w.orderBy(F.desc("image"), "cand_idx")))
    picked = best.withColumns({"_ci": F.max(F.when(F.col("chosen"), F.col("image"))).over(w), "_cs": F.max(F.when(F.col("chosen"), F.col("score"))).over(w)})
    swap = (F.col("_k") == 1) & (F.col("image") - F.col("_ci") >= gap) & (F.col("_cs") - F.col("score") < votes)
    swapped = F.max(swap.cast("int")).over(w)
    return picked.withColumn("_new", F.when(swapped == 1, swap).otherwise(F.col("chosen"))).where("_new").select("sample_id", "cand_idx", "score", "image", (~F.col("chosen")).alias("replaced"))


def top_list(candidates: DataFrame, k: int, score: str = "soft") -> DataFrame:
    """The k best of a sample, stable (O126)."""
    order = Window.partitionBy("sample_id").orderBy(F.desc(score), "cand_idx")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def penalties(candidates: DataFrame, keys: list[str], tau_l: float = 60.0, tau_a: float = 0.06) -> DataFrame:
    """Pairwise disagreement of candidates of different samples of a group: capped squared distances of the
    landings and of the linear parts (O127).  ``candidates``: keys, sample_id, cand_idx, pose, land_x, land_y."""
    take = lambda s: candidates.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("sample_id", "cand_idx", "pose", "land_x", "land_y")])
    p = take("u").join(take("v"), keys).where("sample_id_u < sample_id_v")
    sq = lambda a, b: (a - b) * (a - b)
    dl = sq(F.col("land_x_u"), F.col("land_x_v")) + sq(F.col("land_y_u"), F.col("land_y_v"))
    da = sum((sq(F.col("pose_u")[n], F.col("pose_v")[n]) for n in ("b", "c", "d")), sq(F.col("pose_u")["a"], F.col("pose_v")["a"]))
    psi = F.least(F.lit(1.0), dl / (tau_l * tau_l)) + F.least(F.lit(1.0), da / (tau_a * tau_a))
    return p.select(*keys, "sample_id_u", "cand_idx_u", "sample_id_v", "cand_idx_v", psi.alias("psi"))


def offset_weights(offsets: DataFrame, keys: list[str], rho: float = 400.0) -> DataFrame:
    """Symmetric weights of sample pairs from row-normalised exp(-distance / rho) (O127)."""
    a = offsets.select(*keys, F.col("sample_id").alias("u"), F.col("ox").alias("_x"), F.col("oy").alias("_y"))
    b = offsets.select(*keys, F.col("sample_id").alias("v"), "ox", "oy")
    e = a.join(b, keys).where("u <> v").withColumn("e", F.exp(-g.distance(F.col("_x"), F.col("_y"), F.col("ox"), F.col("oy")) / rho))
    w = e.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy(*keys, "u"))).select(*keys, "u", "v", "w")
    back = w.select(*keys, F.col("u").alias("v"), F.col("v").alias("u"), F.col("w").alias("_w"))
    return w.join(back, [*keys, "u", "v"]).select(*keys, "u", "v", (0.5 * (F.col("w") + F.col("_w"))).alias("w"))


def candidate_features(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per-pair features of mutual pairs: both sides' statistics, ordinal contrast ranks, counts.

    ``left``/``right``: sample_id, idx, area, mean, contrast; ``pairs``: sample_id, i, j, d.
    """
    w = Window.partitionBy("sample_id")

    def side(t: DataFrame, key: str, p: str) -> DataFrame:
        rank = (F.row_number().over(w.orderBy("contrast", "idx")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
        return t.select("sample_id", F.col("idx").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("area", "mean", "contrast")], rank.alias(f"{p}_rank"), F.count("*").over(w).alias(f"{p}_n"))

    close = F.count_if(F.col("d") < 5).over(w)
    return pairs.join(side(left, "i", "iv"), ["sample_id", "i"]).join(side(right, "j", "ex"), ["sample_id", "j"]).withColumn("close5", close)


def gate_sweep(chosen: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Regions kept, kept correct and kept wrong under each named predicate, in one pass.
    ``chosen``: one row a region with ``correct``."""
    listed = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(p, F.lit(False)).alias("on")) for n, p in gates.items()])
    rows = chosen.select("correct", F.inline(listed))
    return rows.groupBy("gate").agg(F.count_if("on").alias("kept"), F.count_if(F.col("on") & F.col("correct")).alias("good"), F.count_if(F.col("on") & ~F.col("correct")).alias("wrong"))


def top_fraction(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Rows at or above the group's (1 - share) quantile."""
    cut = rows.groupBy(*keys).agg(F.percentile(value, F.lit(1.0 - share)).alias("_cut"))
    return rows.join(cut, keys).where(F.col(value) >= F.col("_cut")).drop("_cut")


def field_inside(pose: Column, h: Column, w: Column, canvas_h: Column, canvas_w: Column) -> Column:
    """The centre of the moved field lies on the canvas."""
    x, y = g.move_x(pose, w / 2, h / 2), g.move_y(pose, w / 2, h / 2)
    return (x >= 0) & (x < canvas_w) & (y >= 0) & (y < canvas_h)


def matched_ids(pairs: DataFrame, side: str) -> DataFrame:
    """The distinct ids of one side of selected pairs."""
    return pairs.select("sample_id", side).distinct()
