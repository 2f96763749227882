"""Point clouds: centroids, neighbour joins under a pose, scores of a pose.

``points`` hold sample_id, idx, x, y and anything more.  Neighbours are joined through a grid of
``radius``-wide cells with the nine cells around each source, so that Spark sees an equi-join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import blocks


#: Tasks that the left side is dealt to where all pairs of a sample are looked at.
PARTS = 64


def centroids(pixels: DataFrame, keys: list[str], ghosts: bool = False) -> DataFrame:
    """Centre and area of each label > 0; with ``ghosts`` ids missing below the largest get (0, 0)."""
    real = pixels.where("label > 0").groupBy(*keys, "label").agg(F.avg(F.col("col").cast("double")).alias("x"), F.avg(F.col("row").cast("double")).alias("y"), F.count("*").alias("area"))
    if not ghosts:
        return real
    every = real.groupBy(*keys).agg(F.max("label").alias("_n")).select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("label"))
    filled = every.join(real.withColumn("label", F.col("label").cast("long")), [*keys, "label"], "left")
    return filled.select(*keys, "label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y")], F.coalesce("area", F.lit(0).cast("long")).alias("area"))


def label_stats(pixels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Area and the mean of each value column a label."""
    return pixels.where("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("area"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def shape_features(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Box fill, eccentricity from second moments, and core mean (value over its label mean) a label."""
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    box = (F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)
    sums = pixels.where("label > 0").groupBy(*keys, "label").agg(
        F.count("*").alias("area"), (F.count("*") / box).alias("fill"), F.var_pop(row).alias("_r"), F.var_pop(col).alias("_c"), F.covar_pop(row, col).alias("_rc"), F.max("v").alias("core"),
    )
    # one twelfth: the spread of a pixel itself
    r, c = F.col("_r") + 1 / 12, F.col("_c") + 1 / 12
    root = F.sqrt((r - c) * (r - c) + 4 * F.col("_rc") * F.col("_rc"))
    return sums.select(*keys, "label", "area", "fill", "core", F.sqrt(F.greatest(F.lit(0.0), 1 - (r + c - root) / (r + c + root))).alias("eccentricity"))


def transform(points: DataFrame, pose: Column) -> DataFrame:
    """Affine projection of x and y."""
    x, y = F.col("x"), F.col("y")
    return points.withColumns({"x": g.move_x(pose, x, y), "y": g.move_y(pose, x, y)})


def within(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = True) -> DataFrame:
    """All pairs of a sample up to ``radius`` apart: sample_id, i, j, d.

    The bucket side is exploded to nine cells, once a left point.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.select("sample_id", F.col("idx").alias("i"), F.col("x").alias("_xi"), F.col("y").alias("_yi"))
    a = a.withColumn("_bx", F.explode(F.transform(near, lambda o: F.floor(F.col("_xi") / radius) + o)))
    a = a.withColumn("_by", F.explode(F.transform(near, lambda o: F.floor(F.col("_yi") / radius) + o)))
    b = right.select("sample_id", F.col("idx").alias("j"), F.col("x").alias("_xj"), F.col("y").alias("_yj"), cell("x").alias("_bx"), cell("y").alias("_by"))
    d = g.distance(F.col("_xi"), F.col("_yi"), F.col("_xj"), F.col("_yj"))
    pairs = a.join(b, ["sample_id", "_bx", "_by"]).select("sample_id", "i", "j", d.alias("d"))
    return pairs.where(F.col("d") <= radius if inclusive else F.col("d") < radius)


def nearest_two(left: DataFrame, right: DataFrame, reach: float, inclusive: bool = True, levels: int = 1) -> DataFrame:
    """Of each left point the nearest right point of its sample (ties to the lower index) and how far off the second is (null:
    none in reach): sample_id, level, i, j, d, second.  Targets may take part in several ``levels``: bits of a column ``_in``.

    No pair of points becomes a row, however many lie in reach."""
    types, given = dict(left.dtypes), "_in" in right.columns
    a = left.select("sample_id", "idx", "x", "y")
    b = right.select("sample_id", "idx", "x", "y", F.col("_in") if given else F.lit(1).cast("long").alias("_in"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("idx")
        (source, target), marks, known, out = (t[["x", "y"]].to_numpy(float) for t in (a, b)), b["_in"].to_numpy(np.int64), {}, []
        ids = b.idx.to_numpy()
        for level in range(levels):
            on = (marks >> level & 1).astype(bool)
            if on.tobytes() not in known:
                known[on.tobytes()] = blocks.nearest_two(source, target[on], reach, inclusive)
            j, d, second = known[on.tobytes()]
            met = j >= 0
            out.append(pd.DataFrame({"sample_id": a.sample_id.to_numpy()[met], "level": level, "i": a.idx.to_numpy()[met], "j": ids[on][j[met]], "d": d[met], "second": np.where(np.isfinite(second), second, np.nan)[met]}))
        return pd.concat(out)

    schema = f"sample_id {types['sample_id']}, level int, i {types['idx']}, j {dict(right.dtypes)['idx']}, d double, second double"
    met = blocks.compare(a, b, ["sample_id"], ("idx", "idx"), run, schema)
    # a sample of several parts gives a row a part
    best = met.groupBy("sample_id", "level", "i").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "j", "second"))), 1, 2).alias("_m"))
    return best.select("sample_id", "level", "i", F.col("_m")[0]["j"].alias("j"), F.col("_m")[0]["d"].alias("d"), F.least(F.col("_m")[0]["second"], F.get("_m", F.lit(1))["d"]).alias("second"))


def ranked(pairs: DataFrame) -> DataFrame:
    """rank_i: place of j among i's neighbours; rank_j: place of i among j's; ties to the lower index."""
    of = lambda key, other: F.row_number().over(Window.partitionBy("sample_id", key).orderBy("d", other))
    return pairs.withColumn("rank_i", of("i", "j")).withColumn("rank_j", of("j", "i"))


def nearest_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Each source proposes its one nearest target strictly within ``radius``; a target keeps the closest
    proposer and the others get nothing (O45)."""
    near = within(left, right, radius, inclusive=False)
    first = near.withColumn("_k", F.row_number().over(Window.partitionBy("sample_id", "i").orderBy("d", "j"))).where("_k = 1")
    kept = first.withColumn("_k", F.row_number().over(Window.partitionBy("sample_id", "j").orderBy("d", "i"))).where("_k = 1")
    return kept.drop("_k")


def mutual_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs that are each other's nearest, strictly within ``radius``."""
    return ranked(within(left, right, radius, inclusive=False)).where("rank_i = 1 AND rank_j = 1").select("sample_id", "i", "j", "d")


def bright_or_all(points: DataFrame, least: float, fallback: int = 3) -> DataFrame:
    """Points of at least ``least`` brightness, or all of a sample where fewer than ``fallback`` are."""
    bright = F.col("brightness") >= least
    count = F.count_if(bright).over(Window.partitionBy("sample_id"))
    return points.withColumn("_n", count).where(bright | (F.col("_n") < fallback)).drop("_n")


def ratio_test(left: DataFrame, right: DataFrame, radius: float, ratio: float, floor: float = 0.5) -> DataFrame:
    """Nearest pairs whose source has no second target nearer than ratio x max(d, floor)."""
    pairs = nearest_pairs(left, right, radius)
    reach = ratio * max(radius, floor)
    order = Window.partitionBy("sample_id", "i").orderBy("d", "j")
    second = within(left, right, reach).withColumn("_k", F.row_number().over(order)).where("_k = 2").select("sample_id", "i", F.col("d").alias("second"))
    return pairs.join(second, ["sample_id", "i"], "left").where(F.col("second").isNull() | (F.col("second") >= ratio * F.greatest("d", F.lit(floor)))).drop("second")


def soft_score(left: DataFrame, right: DataFrame, sigma: float = 2.5) -> DataFrame:
    """Sum over mutual pairs of exp(-d^2 / 2 sigma^2); beyond 12 sigma a term is below 1e-31."""
    pairs = mutual_pairs(left, right, 12 * sigma)
    return pairs.groupBy("sample_id").agg(F.count("*").alias("n_pairs"), F.sum(F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))).alias("soft"))


def refine_score(left: DataFrame, right: DataFrame, radius: float = 8.0) -> DataFrame:
    """Sum over nearest pairs of w (1 + max(0, 1 - d / radius)); w: column ``weight`` of the targets."""
    weights = right.select("sample_id", F.col("idx").alias("j"), F.col("weight") if "weight" in right.columns else F.lit(1.0).alias("weight"))
    pairs = nearest_pairs(left, right, radius).join(weights, ["sample_id", "j"])
    return pairs.groupBy("sample_id").agg(F.sum(F.col("weight") * (1 + F.greatest(F.lit(0.0), 1 - F.col("d") / radius))).alias("score"))


def objectives(left: DataFrame, right: DataFrame, sigmas=(1.5, 2.5, 4.0), radii=(3.0, 5.0, 8.0)) -> DataFrame:
    """Soft scores at several widths and mutual pairs at several radii in one pass."""
    pairs = mutual_pairs(left, right, 12 * max(sigmas))
    soft = [F.sum(F.exp(-F.col("d") * F.col("d") / (2 * s * s))).alias(f"soft_{i}") for i, s in enumerate(sigmas)]
    close = [F.count_if(F.col("d") < r).alias(f"close_{i}") for i, r in enumerate(radii)]
    return pairs.groupBy("sample_id").agg(*soft, *close)


def jitter_lattice(step: int = 8, reach: int = 40, inner: float = 15.0, outer: float = 45.0) -> list[tuple[float, float]]:
    """Shifts of the null hypothesis: lattice points of a ring."""
    axis = range(-reach, reach + 1, step)
    return [(float(dx), float(dy)) for dx in axis for dy in axis if inner <= math.hypot(dx, dy) <= outer]


def evidence_z(points: DataFrame, evidence: DataFrame, sizes: DataFrame, least_points: int = 10, least_nulls: int = 5) -> DataFrame:
    """How much better projected points hit the evidence map than shifted copies of them do.

    ``evidence``: sample_id, row, col of the map's true pixels; ``sizes``: sample_id, h, w.  z is -9 where
    too few points or shifts are inside.
    """
    shifts = [(0.0, 0.0), *jitter_lattice()]
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(shifts)])
    moved = points.select("sample_id", "x", "y", F.explode(listed).alias("s")).select("sample_id", "s.k", F.rint(F.col("x") + F.col("s.dx")).cast("long").alias("col"), F.rint(F.col("y") + F.col("s.dy")).cast("long").alias("row"))
    inside = moved.join(sizes, "sample_id").where("row >= 0 AND row < h AND col >= 0 AND col < w")
    marks = evidence.select("sample_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(1.0).alias("hit")).distinct()
    rates = inside.join(marks, ["sample_id", "row", "col"], "left").groupBy("sample_id", "k").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least_points)
    by = rates.groupBy("sample_id").agg(F.max(F.when(F.col("k") == 0, F.col("rate"))).alias("own"), F.avg(F.when(F.col("k") > 0, F.col("rate"))).alias("mean"), F.stddev_pop(F.when(F.col("k") > 0, F.col("rate"))).alias("sd"), F.count_if(F.col("k") > 0).alias("nulls"))
    good = F.col("own").isNotNull() & (F.col("nulls") >= least_nulls)
    z = F.when(good, (F.col("own") - F.col("mean")) / (F.col("sd") + 1e-3)).otherwise(-9.0)
    return points.select("sample_id").distinct().join(by.select("sample_id", z.alias("z")), "sample_id", "left").select("sample_id", F.coalesce("z", F.lit(-9.0)).alias("z"))


def retained(masks: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Masks with a point within ``radius`` of their centre (O49, semi-join)."""
    return masks.join(within(masks, points, radius).select("sample_id", F.col("i").alias("idx")), ["sample_id", "idx"], "left_semi")


def seeds(points: DataFrame, masks: DataFrame, radius: float) -> DataFrame:
    """Points without a mask centre within ``radius`` (O49, anti-join)."""
    return points.join(within(points, masks, radius).select("sample_id", F.col("i").alias("idx")), ["sample_id", "idx"], "left_anti")


def support(points: DataFrame, radius: float) -> DataFrame:
    """For each point of a source, how many sources (its own included) have one within ``radius``.

    ``points``: sample_id, source, idx (unique in the sample), x, y.
    """
    of = points.select("sample_id", F.col("idx").alias("j"), F.col("source").alias("other"))
    own = points.select("sample_id", F.col("idx").alias("i"), "source")
    pairs = within(points, points, radius).join(of, ["sample_id", "j"]).join(own, ["sample_id", "i"])
    return pairs.groupBy("sample_id", F.col("i").alias("idx"), "source").agg(F.count_distinct("other").alias("votes"))


def ordinal_rank(rows: DataFrame, keys: list[str], value: str, tie: str, out: str) -> DataFrame:
    """(place - 1) / max(n - 1, 1): ordinal, ties by ``tie`` (O140)."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(value, tie)) - 1
    return rows.withColumn(out, place / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


def percentile_normalise(pixels: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Clip to two exact percentiles of the group and scale to [0, 1]."""
    limits = pixels.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    return pixels.join(limits, keys).withColumn("norm", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def descriptors(points: DataFrame, bins: int = 8, low: float = 2.0, high: float = 200.0) -> DataFrame:
    """Histogram of log distances to the other points of the sample, of unit length.

    Within a sample this is an all-pairs join by nature; samples are fields of some hundred cells.
    """
    a = points.select("sample_id", F.col("idx").alias("i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    b = points.select("sample_id", F.col("idx").alias("j"), "x", "y")
    d = a.repartition(PARTS, "i").join(b, "sample_id").where("i <> j").select("sample_id", "i", g.distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")).alias("d")).where(F.col("d").between(low, high))
    slot = F.least(F.floor((F.log("d") - math.log(low)) / ((math.log(high) - math.log(low)) / bins)), F.lit(bins - 1)).cast("int")
    hist = d.groupBy("sample_id", "i", slot.alias("bin")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("sample_id", "i")))
    return hist.select("sample_id", "i", "bin", (F.col("n") / norm).alias("w"))


def similarity(left: DataFrame, right: DataFrame, bins: int = 8) -> DataFrame:
    """Cosine of descriptors of one sample: sample_id, i, j, cosine, where they share a bin.

    The pairs are the result.  A point's bins are columns, so that a pair is made and summed in one place; the left side is
    dealt to parts, so that a sample is no one task.
    """
    weights = lambda p: [F.max(F.when(F.col("bin") == k, F.col("w"))).alias(f"{p}{k}") for k in range(bins)]
    a = left.groupBy("sample_id", "i").agg(*weights("_a")).na.fill(0.0).repartition(PARTS, "i")
    b = right.groupBy("sample_id", F.col("i").alias("j")).agg(*weights("_b")).na.fill(0.0)
    total = sum((F.col(f"_a{k}") * F.col(f"_b{k}") for k in range(1, bins)), F.col("_a0") * F.col("_b0"))
    dealt = a.withColumn("_part", F.pmod(F.xxhash64("i"), F.lit(PARTS)).cast("int"))
    every = b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(every, ["sample_id", "_part"]).select("sample_id", "i", "j", total.alias("cosine")).where("cosine > 0")


def expected_random(n_left: Column, n_right: Column, h: Column, w: Column, radius: float) -> Column:
    """Pairs that chance alone would give (O195)."""
    return n_left * n_right / (h * w) * math.pi * radius * radius
