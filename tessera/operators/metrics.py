"""Scores, threshold and gate sweeps, match search, ranking, result comparison."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels
from tessera.operators import points as pt
from tessera.operators.cells import small
from tessera.plans.stages import ensure_checkpoint_dir

# Pair probability thresholds 0 to 0.3 by 0.025, gate thresholds 0 to 1 by 0.05.
THRESHOLDS = tuple(round(0.025 * i, 3) for i in range(13))
TAUS = tuple(round(0.05 * i, 2) for i in range(21))


def f1(tp: Column, pred: Column, total: Column) -> Column:
    """2 tp / (pred + total); 0 where both are empty."""
    return F.coalesce(F.try_divide(2.0 * tp, pred + total), F.lit(0.0))


def listed(values, name: str) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def pair_f1(regions: DataFrame) -> DataFrame:
    """``regions``: subject, sample_id, tp, pred, n_gt, kept, wrong.  Per subject and (null) pooled in one
    rollup; a region that is not kept predicts nothing but its truth counts (O69)."""
    on = F.col("kept").cast("int")
    sums = regions.rollup("subject").agg(F.sum(F.col("tp") * on).alias("tp"), F.sum(F.col("pred") * on).alias("pred"), F.sum("n_gt").alias("n_gt"), F.sum(on).cast("long").alias("kept"), F.sum(on * F.col("wrong").cast("int")).cast("long").alias("kept_wrong"))
    return sums.select("subject", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), "kept", "kept_wrong", f1(F.col("tp"), F.col("pred"), F.col("n_gt")).alias("f1"))


def full_score(pq_iv: Column, pq_ex: Column, pair: Column) -> Column:
    return 0.25 * pq_iv + 0.25 * pq_ex + 0.5 * pair


def true_pairs(predicted: DataFrame, links_i: DataFrame, links_j: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``tp``: both masks are linked and the linked pair is in the truth.

    ``links_*``: sample_id, i / j, link (-1: none); ``truth``: sample_id, gt_i, gt_j.
    """
    a = links_i.select("sample_id", "i", F.col("link").alias("gt_i"))
    b = links_j.select("sample_id", "j", F.col("link").alias("gt_j"))
    known = truth.select("sample_id", "gt_i", "gt_j").distinct().withColumn("_t", F.lit(True))
    out = predicted.join(a, ["sample_id", "i"], "left").join(b, ["sample_id", "j"], "left").join(known, ["sample_id", "gt_i", "gt_j"], "left")
    return out.withColumn("tp", F.coalesce("_t", F.lit(False))).drop("_t", "gt_i", "gt_j")


def threshold_table(pairs: DataFrame, total_gt: int, thresholds=THRESHOLDS) -> DataFrame:
    """``pairs``: prob, y of already one-to-one pairs of kept regions.  One pass for all thresholds (O133):
    each pair falls into the step of the largest threshold it reaches, and steps are summed from above."""
    grid = sorted(thresholds)
    step = sum((F.col("prob") >= t).cast("int") for t in grid[1:]) + (F.col("prob") >= grid[0]).cast("int")
    by = pairs.select(step.alias("step"), F.col("y").cast("long").alias("y")).where("step > 0").groupBy("step").agg(F.sum("y").alias("tp"), F.count("*").alias("pred"))
    every = pairs.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "step int, threshold double")
    down = Window.orderBy(F.desc("step"))  # one row a threshold
    out = every.join(F.broadcast(by), "step", "left").select("threshold", F.coalesce(F.sum("tp").over(down), F.lit(0)).alias("tp"), F.coalesce(F.sum("pred").over(down), F.lit(0)).alias("pred"))
    return out.withColumn("f1", f1(F.col("tp"), F.col("pred"), F.lit(total_gt)))


def best_threshold(table: DataFrame) -> DataFrame:
    """Highest F1, lowest threshold on ties."""
    return table.orderBy(F.desc("f1"), "threshold").limit(1)


def gate_grid(regions: DataFrame, pairs: DataFrame, total_gt: int, taus=TAUS, thresholds=THRESHOLDS) -> DataFrame:
    """For every tau: kept, correct and wrong regions and the best pair F1 with its threshold (O132).

    ``regions``: sample_id, prob, v10, registered, has_gt, correct; ``pairs``: sample_id, prob, y.  A region
    is kept exactly for the taus up to its own limit, so pairs are summed once by (tau step, threshold step).
    """
    spark = regions.sparkSession
    taus, grid = sorted(taus), sorted(thresholds)
    keep = F.when(~F.col("registered"), 0).when(F.col("v10"), len(taus)).otherwise(sum((F.coalesce(F.col("prob") >= t, F.lit(False))).cast("int") for t in taus))
    limit = regions.withColumn("steps", keep)
    counts = limit.groupBy("steps").agg(F.count("*").alias("n"), F.count_if(F.col("has_gt") & F.col("correct")).alias("good"), F.count_if(F.col("has_gt") & ~F.col("correct")).alias("bad"))
    every = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(taus)], "k int, tau double")
    kept = every.join(F.broadcast(counts), F.expr("steps >= k"), "left").groupBy("k", "tau").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(o) for c, o in (("n", "kept"), ("good", "correct"), ("bad", "wrong"))])
    step = sum((F.col("p.prob") >= t).cast("int") for t in grid)
    by = pairs.alias("p").join(limit.select("sample_id", "steps"), "sample_id").select("steps", step.alias("level"), F.col("p.y").cast("long").alias("y")).groupBy("steps", "level").agg(F.sum("y").alias("tp"), F.count("*").alias("pred"))
    levels = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "h int, pair_threshold double")
    cells = every.crossJoin(F.broadcast(levels)).join(F.broadcast(by), F.expr("steps >= k AND level >= h"), "left").groupBy("k", "h", "pair_threshold").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("pred"), F.lit(0)).alias("pred"))
    cells = cells.withColumn("f1", f1(F.col("tp"), F.col("pred"), F.lit(total_gt)))
    best = cells.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("f1"), "h"))).where("_r = 1")
    return kept.join(best, "k").select("tau", "kept", "correct", "wrong", "f1", "pair_threshold", "tp", "pred")


def gate_choice(grid: DataFrame) -> DataFrame:
    """Conservative: lowest tau without a wrong region (null: unavailable); aggressive: highest F1, highest
    tau on ties."""
    return grid.agg(F.min(F.when(F.col("wrong") == 0, F.col("tau"))).alias("conservative"), F.max_by("tau", F.struct("f1", "tau")).alias("aggressive"))


# The settings of the whole search; ratio 0 and gate 0 stand for none.
SEARCH = {"distances": (3, 4, 5, 6, 7, 8, 10, 12), "brightness": (0.0, 0.45, 0.55, 0.65, 0.75, 0.85), "ratios": (0.0, 1.5, 2.0, 2.5, 3.0), "gates": (0.0, 0.06, 0.08, 0.10, 0.14)}


def match_counts(left: DataFrame, right: DataFrame, truth: DataFrame | Column, distances, brightness, ratios, method: str = "greedy") -> DataFrame:
    """TP and predictions of every (distance, brightness, ratio) a sample (O134).

    ``right`` has ``brightness``; ``truth``: sample_id, i, j, or a predicate on them.  The two nearest targets of each brightness
    level are searched once; every configuration is a filter on them.  Method "hungarian" takes most pairs, then least distance, of
    the edges of each sample, brightness and distance.
    """
    reach = max(1.0, *ratios) * max(max(distances), 0.5)
    # a level with fewer than three bright targets has all
    bright = [F.coalesce(F.col("brightness") >= b, F.lit(False)) for b in brightness]
    counts = right.groupBy("sample_id").agg(*[F.count_if(b).alias(f"_n{k}") for k, b in enumerate(bright)])
    marks = sum((F.when(b | (F.col(f"_n{k}") < 3), 1 << k).otherwise(0) for k, b in enumerate(bright)), F.lit(0)).cast("long")
    marked = right.join(counts, "sample_id").select("sample_id", "idx", "x", "y", marks.alias("_in"))
    value = F.element_at(F.array(*[F.lit(b) for b in brightness]), F.col("level") + 1).alias("min_brightness")
    nearest = pt.nearest_two(left, marked, reach, levels=len(brightness)).select("sample_id", value, "i", "j", "d", "second")
    reached = listed([float(d) for d in distances], "distance")
    if method == "greedy":
        # who is nearest to a target does not depend on the distance that is allowed
        order = Window.partitionBy("sample_id", "min_brightness", "j").orderBy("d", "i")
        kept = nearest.where(F.col("d") < float(max(distances))).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
        spread = kept.select("*", reached).where("d < distance")
    else:
        spread = kernels.hungarian_levels(left, marked, [float(b) for b in brightness], [float(d) for d in distances])
        spread = spread.join(nearest.select("sample_id", "min_brightness", "i", "second"), ["sample_id", "min_brightness", "i"])
    spread = spread.select("sample_id", "min_brightness", "distance", "i", "j", "d", "second", listed([float(r) for r in ratios], "ratio"))
    spread = spread.where(F.col("second").isNull() | (F.col("second") >= F.col("ratio") * F.greatest("d", F.lit(0.5))))
    if isinstance(truth, Column):
        marked = spread.withColumn("_t", F.when(truth, 1))
    else:
        marked = spread.join(truth.select("sample_id", "i", "j").distinct().withColumn("_t", F.lit(1)), ["sample_id", "i", "j"], "left")
    return marked.groupBy("sample_id", "distance", "min_brightness", "ratio").agg(F.count("_t").alias("tp"), F.count("*").alias("pred"))


def match_search(left: DataFrame, right: DataFrame, truth: DataFrame | Column, total_gt: int, distances, brightness, ratios) -> DataFrame:
    """TP, predictions and F1 of every (distance, brightness, ratio) over all samples (O134)."""
    counts = match_counts(left, right, truth, distances, brightness, ratios)
    sums = counts.groupBy("distance", "min_brightness", "ratio").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"))
    return sums.withColumn("f1", f1(F.col("tp"), F.col("pred"), F.lit(total_gt)))


def gated_search(counts: DataFrame, kept: DataFrame, keys: list[str], total_gt: int) -> DataFrame:
    """Sums of ``match_counts`` over the samples that each gate keeps.  ``counts``: keys, sample_id and the settings;
    ``kept``: keys, gate, sample_id."""
    by = [*keys, "gate", "distance", "min_brightness", "ratio"]
    sums = counts.join(kept, [*keys, "sample_id"]).groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"))
    return sums.withColumn("f1", f1(F.col("tp"), F.col("pred"), F.lit(total_gt)))


def best_pair_of_settings(invivo: DataFrame, exvivo: DataFrame, top: int = 2) -> DataFrame:
    """The ``top`` settings of each source by PQ, all pairs of an in-vivo and an ex-vivo one, best sum first (O136).
    Both: setting, source, pq."""
    def few(t: DataFrame, p: str) -> DataFrame:
        order = Window.partitionBy("source").orderBy(F.desc("pq"), "setting")
        return t.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).select(F.col("setting").alias(f"{p}_setting"), F.col("pq").alias(f"{p}_pq"))

    both = few(invivo, "iv").crossJoin(F.broadcast(few(exvivo, "ex")))  # top rows a source
    return both.withColumn("total", F.col("iv_pq") + F.col("ex_pq")).orderBy(F.desc("total"), "iv_setting", "ex_setting")


def rank_configs(configs: DataFrame) -> DataFrame:
    """Accepted configurations by full score, F1, fewest wrong (O137)."""
    order = Window.orderBy(F.desc("full"), F.desc("f1"), "kept_wrong", "name")  # one row a configuration
    return configs.where("accepted").withColumn("place", F.row_number().over(order))


def accepted(candidate: Column, target: Column) -> Column:
    """Strictly better, unrounded."""
    return candidate > target


def reproduced(value: Column, target: Column, tolerance: float) -> Column:
    return F.abs(value - target) <= tolerance


def unlock_table(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Pairs a region before and after, and whether it is newly unlocked (O81).  Both: sample_id, n_pairs."""
    b = base.select("sample_id", F.col("n_pairs").alias("before"))
    c = candidate.select("sample_id", F.col("n_pairs").alias("after"))
    out = b.join(c, "sample_id", "left").select("sample_id", "before", F.coalesce("after", F.lit(0)).alias("after"))
    return out.withColumn("newly_unlocked", (F.col("before") == 0) & (F.col("after") >= 1))


def result_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs only in a, only in b and in both, a key (O16, O82, O147)."""
    left = a.distinct().withColumn("_a", F.lit(1))
    right = b.distinct().withColumn("_b", F.lit(1))
    both = left.join(right, a.columns, "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))


def one_to_one_errors(pairs: DataFrame) -> DataFrame:
    """Ids used more than once on a side (O33): sample_id, side, id, uses."""
    use = lambda c: pairs.groupBy("sample_id", F.lit(c).alias("side"), F.col(c).alias("id")).agg(F.count("*").alias("uses")).where("uses > 1")
    return use("iv_id").unionByName(use("ex_id"))


def missing_ids(pairs: DataFrame, instances: DataFrame) -> DataFrame:
    """Pair members without an instance (O33).  ``instances``: sample_id, modality, cell_id."""
    side = lambda c, m: pairs.select("sample_id", F.lit(m).alias("modality"), F.col(c).alias("cell_id")).distinct()
    return side("iv_id", "invivo").unionByName(side("ex_id", "exvivo")).join(instances, ["sample_id", "modality", "cell_id"], "left_anti")


def grouped_summary(rows: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Count, mean, quartiles and a fixed-bin histogram."""
    slots = [F.count_if((F.col(value) >= lo) & (F.col(value) < hi)).alias(f"bin_{i}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *slots)
    cuts = {f"q{int(100 * q)}": q for q in (0.25, 0.5, 0.75)}
    both = _same_keys(sums, quantiles(rows, keys, value, list(cuts.values())), keys, "left")
    return both.select(*keys, "n", "mean", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(cuts)], *[f"bin_{i}" for i in range(len(slots))])


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", more: tuple[str, ...] = ()) -> DataFrame:
    """Join on equal keys, null ones among them."""
    names = {c: f"_r_{c}" for c in (*keys, *more)}
    right = right.withColumnsRenamed(names)
    met = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()))
    return left.join(right, met, how).drop(*names.values())


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], spans: int = 4096) -> DataFrame:
    """Exact interpolated quantiles a group: keys, _q (an array in the order of ``shares``).  No task holds a group's values: they are
    counted by spans of equal width, and those of the spans that hold a wanted rank alone are counted one by one and put in order."""
    v = F.col(value).cast("double")
    number = F.when(~F.isnan(v), v)
    low, high = rows.agg(F.min(number), F.max(number)).first()
    low, wide = low or 0.0, (high or 0.0) - (low or 0.0)
    scale = spans / wide if 0 < wide < math.inf and spans / wide < math.inf else 0.0
    span = F.when(F.isnan("_v"), F.lit(spans + 1)).otherwise(F.floor(F.nanvl((F.col("_v") - low) * scale, F.lit(0.0)))).cast("int")
    placed = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull()).withColumn("_span", span)
    upto = Window.partitionBy(*keys).orderBy("_span")
    hist = placed.groupBy(*keys, "_span").agg(F.count("*").alias("_c"))
    hist = hist.withColumns({"_to": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in shares]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (f(p).cast("long")).alias("rank"), p.alias("pos")) for i, p in enumerate(place) for f in (F.floor, F.ceil)])
    wanted = hist.select("*", F.explode(F.array_distinct(ranks)).alias("_w")).where((F.col("_w.rank") < F.col("_to")) & (F.col("_w.rank") >= F.col("_to") - F.col("_c")))
    wanted = wanted.select(*keys, "_span", (F.col("_to") - F.col("_c")).alias("_before"), "_w.*")
    ensure_checkpoint_dir(rows.sparkSession)
    wanted = wanted.checkpoint()  # a few rows a group
    spots = small(wanted.select(*keys, "_span", "_before").distinct())
    counted = _same_keys(placed, spots, keys, more=("_span",)).groupBy(*keys, "_span", "_before", "_v").agg(F.count("*").alias("_c"))
    counted = counted.withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_span").orderBy("_v")))
    found = _same_keys(counted.select(*keys, "_span", "_v", "_c", "_to"), small(wanted.drop("_before")), keys, more=("_span",))
    found = found.where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_c")))
    ends = found.groupBy(*keys, "i").agg(F.max("pos").alias("_p"), F.min_by("_v", "rank").alias("_a"), F.max_by("_v", "rank").alias("_b"))
    between = (F.ceil("_p") - F.col("_p")) * F.col("_a") + (F.col("_p") - F.floor("_p")) * F.col("_b")
    return ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("q")))), lambda x: x["q"]).alias("_q"))


def leave_one_out(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every row once a fold, with whether it trains or is held out (O177); subjects are few."""
    folds = subjects.select(F.col("subject").alias("fold")).distinct()
    return rows.crossJoin(F.broadcast(folds)).withColumn("held_out", F.col("subject") == F.col("fold"))


def pose_diagnostics(errors: DataFrame, top: int = 5) -> DataFrame:
    """Regions, those whose first candidate is correct, with a correct one among the first ``top`` or at all,
    and the median best error (O82).  ``errors``: sample_id, cand_idx, place (from 1), err, correct."""
    by = errors.groupBy("sample_id").agg(F.max(F.col("correct") & (F.col("place") == 1)).alias("one"), F.max(F.col("correct") & (F.col("place") <= top)).alias("some"), F.max("correct").alias("any"), F.min("err").alias("best"))
    return by.agg(F.count("*").alias("regions"), F.count_if("one").alias("first_correct"), F.count_if("some").alias("top_correct"), F.count_if("any").alias("any_correct"), F.percentile("best", F.lit(0.5)).alias("best_error"))


def distance_sweep(left: DataFrame, right: DataFrame, truth: DataFrame, distances) -> DataFrame:
    """TP, FP, FN and F1 of nearest pairs at several distances from one join (O192).  ``truth``: sample_id, i, j."""
    edges = pt.within(left, right, float(max(distances)), inclusive=False).select("*", listed(list(distances), "distance")).where("d < distance")
    of = lambda key, other: F.row_number().over(Window.partitionBy("distance", "sample_id", key).orderBy("d", other))
    kept = edges.withColumn("_k", of("i", "j")).where("_k = 1").withColumn("_k", of("j", "i")).where("_k = 1")
    total = truth.count()
    hit = truth.select("sample_id", "i", "j", F.lit(1).alias("_t"))
    sums = kept.join(hit, ["sample_id", "i", "j"], "left").groupBy("distance").agg(F.count("_t").alias("tp"), F.count("*").alias("pred"))
    return sums.select("distance", "tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.lit(total) - F.col("tp")).alias("fn"), f1(F.col("tp"), F.col("pred"), F.lit(total)).alias("f1"))
