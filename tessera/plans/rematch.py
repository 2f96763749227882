"""The whole match of two point clouds a sample: map, reduce by group, join back, map.

points -> candidates of each sample -> consensus modes of each group -> candidates near the modes -> choice
and margin -> mutual pairs under the chosen pose -> gate.  Two exchanges by sample and one by group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import consensus as cs
from tessera.operators import matching as mt
from tessera.operators import points as pt
from tessera.operators import registration as rg
from tessera.plans.stages import ensure_checkpoint_dir


def chosen_poses(left: DataFrame, right: DataFrame, own: DataFrame, angle_win: float = 5.0) -> DataFrame:
    """One candidate a sample with its margin.  ``own``: ``registration.candidates`` of the samples;
    ``left``: subject, sample_id, idx, x, y, ox, oy."""
    ensure_checkpoint_dir(left.sparkSession)
    own = own.checkpoint()  # candidates cost most and are read several times
    group = left.select("subject", "sample_id").distinct()
    modes = cs.vote_modes(own.join(group, "sample_id"), ["subject"]).checkpoint()
    near = rg.window_candidates(left.drop("subject"), right, group.join(modes, "subject").select("sample_id", "angle", "land_x", "land_y"), angle_win=angle_win)
    every = near.unionByName(own.withColumn("cand_idx", F.col("cand_idx") + 1000)).checkpoint()
    scored = mt.margins(every, "score", "margin")
    return mt.choose_gated(scored, F.col("source") == "window").withColumn("pose", F.struct(*g.POSE))


def matched(left: DataFrame, right: DataFrame, poses: DataFrame, radius: float = 10.0, least_margin: float = 3.0) -> DataFrame:
    """Mutual pairs of the samples whose pose passes the margin gate: sample_id, i, j, d."""
    kept = poses.where(F.col("margin") >= least_margin).select("sample_id", "pose")
    m, x, y = F.col("pose"), F.col("x"), F.col("y")
    moved = left.join(kept, "sample_id").select("sample_id", "idx", g.move_x(m, x, y).alias("x"), g.move_y(m, x, y).alias("y"))
    return pt.mutual_pairs(moved, right, radius)
