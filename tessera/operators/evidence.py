"""Dense image evidence: bands, masked correlation over all shifts, phase correlation, chains of sections, consensus
sampling, and smoothed landing volumes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import kernels as k
from tessera.plans.stages import ensure_checkpoint_dir

# Deviations of the band that pose evidence uses.
BAND = (2.0, 8.0)


def band(image: np.ndarray, low: float = BAND[0], high: float = BAND[1]) -> np.ndarray:
    """Difference of two Gaussians: structure between the two deviations, without the mean (O109, O165)."""
    return k.blur(image, low) - k.blur(image, high)


def masked_correlation(image: np.ndarray, mask: np.ndarray, other: np.ndarray, other_mask: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Normalised correlation of the pixels that are true in both masks, and their number, for every shift of ``other`` over
    ``image`` (O100, O109).  Place [i, j] is the shift (i - other rows + 1, j - other columns + 1).

    Sums, squares and products over each overlap are six products of the transforms of both sides' masks, values
    and squares.  Overlaps of fewer than ``least`` pixels, or without variance, are NaN.
    """
    shape = tuple(a + b - 1 for a, b in zip(image.shape, other.shape))
    size = tuple(1 << (n - 1).bit_length() for n in shape)
    middle = image[mask].mean() if mask.any() else 0.0, other[other_mask].mean() if other_mask.any() else 0.0
    side = lambda v, m, mean: np.fft.rfft2(np.stack([m.astype(float), (v - mean) * m, ((v - mean) ** 2) * m]), size)
    one, two = side(image, mask, middle[0]), side(other[::-1, ::-1], other_mask[::-1, ::-1], middle[1])
    n, s1, s2, q1, q2, both = np.fft.irfft2(np.stack([one[0] * two[0], one[1] * two[0], one[0] * two[1], one[2] * two[0], one[0] * two[2], one[1] * two[1]]), size)[:, : shape[0], : shape[1]]
    n = np.rint(n)
    many = np.maximum(n, 1)
    v1, v2 = q1 - s1 * s1 / many, q2 - s2 * s2 / many
    floor = 1e-9 * np.maximum(1.0, [np.abs(q1).max(), np.abs(q2).max()])
    good = (n >= least) & (v1 > floor[0]) & (v2 > floor[1])
    return np.where(good, (both - s1 * s2 / many) / np.sqrt(np.where(good, v1 * v2, 1.0)), np.nan), n


def _image(part: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    low = part.row.min(), part.col.min()
    image, mask = (np.zeros((part.row.max() - low[0] + 1, part.col.max() - low[1] + 1), kind) for kind in (float, bool))
    at = part.row.to_numpy() - low[0], part.col.to_numpy() - low[1]
    image[at], mask[at] = part[value].to_numpy(float), True
    return image, mask, low


def masked_correlations(left: DataFrame, right: DataFrame, reach: tuple[int, int] | None = None, least: int = 2, bands: tuple[float, float] | None = None) -> DataFrame:
    """sample_id, drow, dcol, ncc, n: correlation of ``left`` with ``right`` moved by each shift (all, or those within ``reach``
    of none).  Both: sample_id, row, col, v, a row a pixel that counts; ``bands`` filters both images first."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["sample_id", "drow", "dcol", "ncc", "n"]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=names)
        (x, mx, at), (y, my, by) = _image(a, "v"), _image(b, "v")
        if bands:
            x, y = band(x, *bands), band(y, *bands)
        ncc, n = masked_correlation(x, mx, y, my, least)
        row, col = (np.arange(ncc.shape[i]) - y.shape[i] + 1 + at[i] - by[i] for i in (0, 1))
        here = (np.abs(row) <= reach[0])[:, None] & (np.abs(col) <= reach[1]) if reach else np.ones(ncc.shape, bool)
        i, j = np.nonzero(here & np.isfinite(ncc))
        return pd.DataFrame({"sample_id": a.sample_id.iloc[0], "drow": row[i], "dcol": col[j], "ncc": ncc[i, j], "n": n[i, j].astype(int)})[names]

    # new names on both sides: they may come from one table
    cut = lambda df: df.select(*[F.col(c).alias(c) for c in ("sample_id", "row", "col", "v")]).groupBy("sample_id")
    return cut(left).cogroup(cut(right)).applyInPandas(run, "sample_id string, drow long, dcol long, ncc double, n long")


# ---------------------------------------------------------------- sections


def phase_shift(moving: np.ndarray, fixed: np.ndarray) -> tuple[float, float, float]:
    """(x, y) by which ``moving`` must be moved to lie on ``fixed``, to a fraction of a pixel, and the height of the peak (O111).

    Only phases are compared, so brightness and contrast play no part; the peak is a parabola through its neighbours
    along each axis.  Both images are tapered to nothing at their borders.
    """
    shape = tuple(max(a, b) for a, b in zip(moving.shape, fixed.shape))
    put = np.zeros((2, *shape))
    for at, image in zip(put, (fixed, moving)):
        taper = np.hanning(image.shape[0] + 2)[1:-1, None] * np.hanning(image.shape[1] + 2)[1:-1]
        at[: image.shape[0], : image.shape[1]] = (image - image.mean()) * taper
    one, two = np.fft.rfft2(put)
    cross = one * two.conj()
    found = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12 * np.abs(cross).max() + 1e-300), shape)
    peak = np.unravel_index(found.argmax(), shape)
    out = []
    for axis in (1, 0):
        at = lambda step: found[tuple((p + step * (i == axis)) % shape[i] for i, p in enumerate(peak))]  # noqa: E731, B023
        bend = at(-1) - 2 * at(0) + at(1)
        shift = peak[axis] + (0.0 if bend >= 0 else (at(-1) - at(1)) / (2 * bend))
        out.append(float(shift - shape[axis] * (shift > shape[axis] / 2)))
    return out[0], out[1], float(found.max())


def chained(sections: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Each section's pose onto the first of its chain (O111): keys, ``order``, pose.

    ``sections``: keys, ``order`` (1, 2, ... without gaps), pose (struct, onto the section before).  Composition is
    associative, so it is a scan by doubling: after a join with the row 1, 2, 4, ... places before, a row holds the
    product of twice as many poses.  No task sees a chain.
    """
    ensure_checkpoint_dir(sections.sparkSession)
    now = sections.select(*keys, order, "pose").checkpoint()
    longest = now.agg(F.max(order)).first()[0] or 0
    for step in (1 << i for i in range(max(0, (longest - 1).bit_length()))):
        before = now.select(*keys, (F.col(order) + step).alias(order), F.col("pose").alias("_before"))
        joined = now.join(before, [*keys, order], "left")
        whole = F.when(F.col("_before").isNull(), F.col("pose")).otherwise(g.compose(F.col("_before"), F.col("pose")))
        now = joined.select(*keys, order, whole.alias("pose")).checkpoint()
    return now


# ---------------------------------------------------------------- consensus sampling


def sampled_affine(source: np.ndarray, target: np.ndarray, cut: float, seed: int = 0, most: int = 2000, sure: float = 0.999, batch: int = 64) -> tuple[np.ndarray | None, np.ndarray]:
    """Affine pose that most pairs agree on within ``cut``, and which those are (O107).

    Triples are drawn by a fixed seed, so reruns agree; the poses of a batch of triples are scored against all
    pairs in one product.  Drawing stops once a triple of only agreeing pairs has been drawn with probability ``sure``.
    The best pose is fitted again to the pairs that agree with it.
    """
    n = len(source)
    agree = np.zeros(n, bool)
    if n < 3:
        return None, agree
    rng, design, drawn, needed = np.random.default_rng(seed), np.c_[source, np.ones(n)], 0, most
    while drawn < min(needed, most):
        triples = rng.integers(0, n, (batch, 3))  # a triple with a point twice has no pose and is left out
        corners = design[triples]
        fit = np.abs(np.linalg.det(corners)) > 1e-6
        drawn += batch
        if not fit.any():
            continue
        poses = np.linalg.solve(corners[fit], target[triples[fit]])
        gap = np.einsum("ni,bij->bnj", design, poses) - target
        inside = (gap**2).sum(2) <= cut * cut
        best = int(inside.sum(1).argmax())
        if inside[best].sum() > agree.sum():
            agree = inside[best]
            share = min((agree.sum() / n) ** 3, 1 - 1e-12)
            needed = math.ceil(math.log(1 - sure) / math.log(1 - share))
    pose = None
    for _ in range(5):
        if agree.sum() < 3 or np.linalg.matrix_rank(design[agree]) < 3:
            return None, agree
        pose = np.linalg.lstsq(design[agree], target[agree], rcond=None)[0].T
        new = ((design @ pose.T - target) ** 2).sum(1) <= cut * cut
        if (new == agree).all():
            break
        agree = new
    return pose, agree


def sampled_poses(pairs: DataFrame, cut: float = 3.0, seed: int = 0) -> DataFrame:
    """``sampled_affine`` of each sample's matched points (sample_id, idx, x, y, gx, gy): pose columns, n pairs, n agreeing."""
    names = ["sample_id", "a", "b", "tx", "c", "d", "ty", "n", "n_agree"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        pose, agree = sampled_affine(part[["x", "y"]].to_numpy(float), part[["gx", "gy"]].to_numpy(float), cut, seed)
        return pd.DataFrame([] if pose is None else [(part.sample_id.iloc[0], *pose.ravel(), len(part), int(agree.sum()))], columns=names)

    return pairs.select("sample_id", "idx", "x", "y", "gx", "gy").groupBy("sample_id").applyInPandas(run, "sample_id string, a double, b double, tx double, c double, d double, ty double, n long, n_agree long")


# ---------------------------------------------------------------- landing volumes


def _widened(volume: DataFrame, place: list[str], axis: str, reach: int) -> DataFrame:
    """The largest value within ``reach`` bins along one axis; the three axes one after the other are a box."""
    spread = volume.withColumn(axis, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)))
    return spread.groupBy(*place).agg(F.max("w").alias("w"))


def landing_volume(votes: DataFrame, keys: list[str], weight: Column, angle_bin: float = 3.0, land_bin: float = 16.0, angle_reach: int = 1, land_reach: int = 4) -> DataFrame:
    """Support of each (angle, landing) bin of a group: over its samples, the sum of the largest vote within reach (O88, O206).

    ``votes``: keys, sample_id, angle, land_x, land_y and what ``weight`` needs; a vote that is not positive counts
    nothing.  Each sample's volume is widened by three shifted aggregations, one an axis, so a vote is sent to
    3 + 9 + 9 places and not to 243, and groups are summed with partial sums.
    """
    bin_ = lambda c, w: F.floor(F.col(c) / w).cast("long")
    axes = {"ba": bin_("angle", angle_bin), "bx": bin_("land_x", land_bin), "by": bin_("land_y", land_bin)}
    place = [*keys, "sample_id", *axes]
    now = votes.withColumns({**axes, "w": weight}).where("w > 0").groupBy(*place).agg(F.max("w").alias("w"))
    for axis, reach in (("ba", angle_reach), ("bx", land_reach), ("by", land_reach)):
        now = _widened(now, place, axis, reach)
    return now.groupBy(*keys, *axes).agg(F.sum("w").alias("support"), F.count("*").alias("n"))


def volume_peaks(volume: DataFrame, keys: list[str], angle_bin: float = 3.0, land_bin: float = 16.0) -> DataFrame:
    """The fullest bin of each group (ties to the lower bin), its centre moved along each axis to the top of the parabola
    through it and its two neighbours: keys, angle, land_x, land_y, support, n."""
    axes = ("ba", "bx", "by")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("support", 9)), *axes)
    top = volume.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    steps = [(0, 0, 0), *(tuple(s * (i == j) for j in range(3)) for i in range(3) for s in (-1, 1))]
    listed = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(axes, s)]) for s in steps])
    asked = top.select(*keys, "support", "n", *[F.col(a).alias(f"_{a}") for a in axes], F.explode(listed).alias("_s"))
    asked = asked.select("*", *[(F.col(f"_{a}") + F.col(f"_s.d{a}")).alias(a) for a in axes])
    near = asked.join(volume.select(*keys, *axes, F.col("support").alias("_w")), [*keys, *axes], "left")
    at = lambda a, step: F.coalesce(F.max(F.when(F.col(f"_s.d{a}") == step, F.col("_w"))), F.lit(0.0))
    row = near.groupBy(*keys, "support", "n", *[f"_{a}" for a in axes]).agg(*[at(a, s).alias(f"{a}{n}") for a in axes for s, n in ((-1, "l"), (1, "r"))])
    out = []
    for a, name, width in zip(axes, ("angle", "land_x", "land_y"), (angle_bin, land_bin, land_bin)):
        bend = F.col(f"{a}l") - 2 * F.col("support") + F.col(f"{a}r")
        move = F.when(F.abs(bend) > 1e-9, (F.col(f"{a}l") - F.col(f"{a}r")) / (2 * bend)).otherwise(0.0)
        out.append(((F.col(f"_{a}") + 0.5 + move) * width).alias(name))
    return row.select(*keys, *out, "support", "n")


def mode_agreement(estimated: DataFrame, truth: DataFrame, keys: list[str], angle_tol: float = 5.0, land_tol: float = 160.0) -> DataFrame:
    """How many true poses of each group (keys, sample_id, angle, land_x, land_y) lie about the estimated mode: keys, n, hits (O206)."""
    e = estimated.select(*keys, F.col("angle").alias("_a"), F.col("land_x").alias("_x"), F.col("land_y").alias("_y"))
    hit = (F.abs(F.col("angle") - F.col("_a")) < angle_tol) & (g.distance(F.col("land_x"), F.col("land_y"), F.col("_x"), F.col("_y")) < land_tol)
    return truth.join(e, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
