"""Instances of a label map: shape vectors, predicates, fusion, boundary variants, paired-cell evaluation.

Pixels are rows (keys, row, col, label > 0, anything more).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import raster as rs
from tessera.plans.stages import ensure_checkpoint_dir

# The twelve gates on margin (mg), evidence (z) and its margin (zm).
GATES = {
    "margin>=3": "mg >= 3", "all": "true", "z>=4": "z >= 4", "z>=5": "z >= 5", "z>=6": "z >= 6", "mg3|z>=5": "mg >= 3 OR z >= 5", "mg3|z>=6": "mg >= 3 OR z >= 6",
    "mg3|zm>=1": "mg >= 3 OR zm >= 1", "mg3|zm>=2": "mg >= 3 OR zm >= 2", "zm>=1": "zm >= 1", "zm>=2": "zm >= 2", "mg3|(z>=4&zm>=1)": "mg >= 3 OR (z >= 4 AND zm >= 1)",
}
# Quantiles of the rim variants, and least pixels of a variant.
RIM_QUANTILES, LEAST_PIXELS = (0.10, 0.25, 0.35, 0.50, 0.60, 0.75), 8


def shape_vector(pixels: DataFrame, keys: list[str], height: Column, width: Column, existing: DataFrame | Column | None = None) -> DataFrame:
    """Size, place, box, circularity, anisotropy, eccentricity and values of each label.

    ``pixels`` carry ``v`` and ``prob``; ``existing``: pixels of another map, for the overlap, or a predicate where a row of
    ``pixels`` tells by itself.  The perimeter counts pixels with another label or none beside them.
    """
    place = [*keys, "row", "col"]
    if existing is None:
        old = pixels.withColumn("_old", F.lit(None).cast("int"))
    elif isinstance(existing, Column):
        old = pixels.withColumn("_old", F.when(existing, 1))
    else:
        old = pixels.join(existing.select(*place, F.lit(1).alias("_old")).distinct(), place, "left")
    marked = rs.same_around(old.select(*place, "label", "v", "prob", "_old"), keys).withColumn("_rim", F.when((F.col("label") > 0) & (F.col("_n") < 4), 1))
    n, x, y = F.count("*"), F.col("col").cast("double"), F.col("row").cast("double")
    sums = marked.groupBy(*keys, "label").agg(
        n.alias("area"), F.count("_rim").alias("perimeter"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_cov"),
        (F.max("col") - F.min("col") + 1).alias("bw"), (F.max("row") - F.min("row") + 1).alias("bh"), F.avg("v").alias("mean_v"), F.max("v").alias("max_v"), F.avg("prob").alias("mean_prob"),
        F.max("prob").alias("max_prob"), F.stddev_pop("prob").alias("sd_prob"), (F.count("_old") / n).alias("overlap"),
    )
    spread = F.sqrt((F.col("_vx") - F.col("_vy")) * (F.col("_vx") - F.col("_vy")) + 4 * F.col("_cov") * F.col("_cov"))
    total = F.col("_vx") + F.col("_vy")
    p = F.greatest("perimeter", F.lit(1)).cast("double")
    return sums.select(
        *keys, "label", "area", F.log1p("area").alias("log_area"), (F.col("cx") / width).alias("cx"), (F.col("cy") / height).alias("cy"), F.log1p("bw").alias("log_bw"), F.log1p("bh").alias("log_bh"),
        (F.col("area") / (F.col("bw") * F.col("bh"))).alias("fill"), (4 * math.pi * F.col("area") / (p * p)).alias("circularity"), (spread / F.greatest(total, F.lit(0.01))).alias("anisotropy"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - (total - spread) / F.greatest(total + spread, F.lit(1e-3)))).alias("eccentricity"), "mean_v", "max_v", "mean_prob", "max_prob", "sd_prob", "overlap", (F.col("area") / p).alias("thickness"),
    )


def steady(value: Column) -> Column:
    """A mean or moment without what the order of its sum leaves in the last places, so that a value on a bound stays on it."""
    return F.round(value, 12)


def selected(pixels: DataFrame, features: DataFrame, keys: list[str], min_core: float = 0.0, min_circularity: float = 0.0, max_eccentricity: float = 1.0, min_fill: float = 0.0) -> DataFrame:
    """Pixels of the labels that pass every bound, with consecutive ids in label order."""
    ok = (steady(F.col("mean_prob")) >= min_core) & (F.col("circularity") >= min_circularity) & (steady(F.col("eccentricity")) <= max_eccentricity) & (F.col("fill") >= min_fill)
    kept = features.where(ok).select(*keys, "label", F.row_number().over(Window.partitionBy(*keys).orderBy("label")).alias("dense"))
    return pixels.join(kept, [*keys, "label"])


def _numbered_after(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the pixels of ``fresh`` that it leaves free, whose labels follow its largest."""
    place = [*keys, "row", "col"]
    top = base.groupBy(*keys).agg(F.max("label").alias("_top"))
    free = fresh.join(base.select(*place), place, "left_anti").join(top, keys, "left")
    return base.select(*place, "label").unionByName(free.select(*place, (F.col("label") + F.coalesce("_top", F.lit(0))).alias("label")))


def overlaps(base: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, area and the share of its pixels that ``base`` holds, a label of ``added``."""
    place = [*keys, "row", "col"]
    marked = added.join(base.select(*place, F.lit(1).alias("_b")).distinct(), place, "left")
    return marked.groupBy(*keys, "label").agg(F.count("*").alias("area"), (F.count("_b") / F.count("*")).alias("share"))


def add_measured(base: DataFrame, added: DataFrame, keys: list[str], most_overlap: float, min_prob: float, min_v: float, low: int = 17, high: int = 350) -> DataFrame:
    """Adds instances of enough mean ``prob`` and ``v``, of allowed size and little overlap."""
    values = added.groupBy(*keys, "label").agg(steady(F.avg("prob")).alias("_p"), steady(F.avg("v")).alias("_v"))
    good = overlaps(base, added, keys).join(values, [*keys, "label"]).where((F.col("share") <= most_overlap) & (F.col("_p") >= min_prob) & (F.col("_v") >= min_v) & F.col("area").between(low, high))
    return _numbered_after(base, added.join(good, [*keys, "label"], "left_semi"), keys)


def add_chosen(base: DataFrame, proposals: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the proposals that ``chosen`` (keys, label) names where the base is free."""
    return _numbered_after(base, proposals.join(chosen, [*keys, "label"], "left_semi"), keys)


def clear_of_truth(truth: DataFrame, teacher: DataFrame, keys: list[str]) -> DataFrame:
    """Teacher instances that touch no truth pixel nor its surroundings of two steps, and the truth with ids after
    theirs; truth wins (O56)."""
    place = [*keys, "row", "col"]
    near = truth.select(*place)
    for _ in range(2):
        steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
        near = near.select(*keys, "row", "col", F.explode(steps).alias("s")).select(*keys, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).distinct()
    touched = teacher.join(near, place, "left_semi").select(*keys, "label").distinct()
    kept = teacher.join(touched, [*keys, "label"], "left_anti").select(*place, "label")
    return _numbered_after(kept, truth.select(*place, "label"), keys)


def voted_fusion(base: DataFrame, sources: DataFrame, votes: DataFrame, keys: list[str], least_votes: int, low: int = 17, high: int = 350) -> DataFrame:
    """Adds instances of several sources that enough sources support and that lie free of the base.

    ``sources``: keys, source, label, row, col; ``votes``: keys, source, label, votes.  Where instances meet, a pixel
    goes to the one of most votes, then the earlier source, then the lower label; ids follow that order.
    """
    place = [*keys, "row", "col"]
    by = [*keys, "source", "label"]
    touching = sources.join(base.select(*place), place, "left_semi").select(*by).distinct()
    sized = sources.groupBy(*by).agg(F.count("*").alias("area")).where(F.col("area").between(low, high)).join(touching, by, "left_anti")
    pool = sized.join(votes, by).where(F.col("votes") >= least_votes)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "source", "label"))
    pool = pool.withColumn("_rank", rank).select(*by, "_rank")
    mine = sources.join(pool, by).groupBy(*place).agg(F.min("_rank").alias("label"))
    return _numbered_after(base, mine, keys)


def _rim_flags(pixels: DataFrame, keys: list[str], quantiles, cuts) -> tuple[DataFrame, list[str]]:
    """``pixels``, each at its label's task, with a flag ``_on0``, ``_on1``, ... a variant, and the variants' names."""
    on_rim = F.col("_n") < 4
    limits = F.percentile(F.when(on_rim, F.col("prob")), F.array(*[F.lit(q) for q in quantiles])).over(Window.partitionBy(*keys, "label"))
    marked = rs.same_around(pixels, keys).withColumn("_q", limits)
    listed = [("base", F.lit(True)), ("e1", ~on_rim)]
    listed += [(f"ep{round(100 * q)}", ~(on_rim & (F.col("prob") <= F.col("_q")[i]))) for i, q in enumerate(quantiles)]
    listed += [(f"cp{t:g}", F.col("prob") > t) for t in cuts]
    flags = [F.coalesce(c, F.lit(False)).alias(f"_on{i}") for i, (_, c) in enumerate(listed)]
    return marked.select(*pixels.columns, *flags), [n for n, _ in listed]


def _rim_kept(pixels: DataFrame, keys: list[str], quantiles, cuts, least: int) -> tuple[DataFrame, list[str]]:
    """``_rim_flags`` in which a variant that leaves too few pixels of a label has them all."""
    flagged, names = _rim_flags(pixels, keys, quantiles, cuts)
    own = Window.partitionBy(*keys, "label")
    flags = [(F.col(f"_on{i}") | (F.count_if(f"_on{i}").over(own) < least)).alias(f"_on{i}") for i in range(len(names))]
    return flagged.select(*pixels.columns, *flags), names


def rim_variants(pixels: DataFrame, keys: list[str], quantiles=RIM_QUANTILES, cuts=(0.0, 1.0, 2.0), least: int = LEAST_PIXELS) -> DataFrame:
    """Pixels of each label under the variants base, e1 (without its rim), epQ (without the rim up to quantile Q of its
    ``prob``) and cpT (``prob`` above T), in one plan; a variant that leaves too few pixels keeps the label whole (O157)."""
    place = [*keys, "row", "col"]
    kept, names = _rim_kept(pixels.select(*place, "label", "prob"), keys, quantiles, cuts, least)
    listed = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_on{i}").alias("_on")) for i, n in enumerate(names)])
    return kept.select(*place, "label", F.inline(listed)).where("_on").select("variant", *place, "label")


def rim_sizes(pixels: DataFrame, keys: list[str], quantiles=RIM_QUANTILES, cuts=(0.0, 1.0, 2.0), least: int = LEAST_PIXELS) -> DataFrame:
    """Pixels of each label under every one of ``rim_variants``, which are counted and not listed: variant, keys, label, pixels."""
    flagged, names = _rim_flags(pixels.select(*keys, "row", "col", "label", "prob"), keys, quantiles, cuts)
    counts = flagged.groupBy(*keys, "label").agg(F.count("*").alias("_all"), *[F.count_if(f"_on{i}").alias(f"_k{i}") for i in range(len(names))])
    of = lambda i: F.when(F.col(f"_k{i}") < least, F.col("_all")).otherwise(F.col(f"_k{i}"))
    listed = F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), of(i).alias("pixels")) for i, n in enumerate(names)]))
    return counts.select(*keys, "label", listed).select("variant", *keys, "label", "pixels")


def _best_ious(links: DataFrame, truth: DataFrame, keys: list[str], names: list[str], least: int) -> DataFrame:
    """``variant_ious`` from counts.  ``links``: keys, label, gt (0: none), _n pixels and _k0, _k1, ... of them a variant;
    ``truth``: keys, gt, _b pixels."""
    own = Window.partitionBy(*keys, "label")
    total = {f"_t{i}": F.sum(f"_k{i}").over(own) for i in range(len(names))}
    rows = links.join(truth, [*keys, "gt"], "left").withColumns({"_all": F.sum("_n").over(own), **total})
    of = lambda i, part, whole: F.when(F.col(f"_t{i}") < least, F.col(whole)).otherwise(F.col(f"{part}{i}"))
    listed = F.array(*[F.struct(F.lit(n).alias("variant"), of(i, "_k", "_n").alias("_i"), of(i, "_t", "_all").alias("_a")) for i, n in enumerate(names)])
    spread = rows.select(*keys, "label", "gt", "_b", F.inline(listed))
    iou = F.struct((F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i"))).alias("iou"), (-F.col("gt")).alias("_g"))
    best = spread.groupBy("variant", *keys, "label").agg(F.max(F.when((F.col("gt") > 0) & (F.col("_i") > 0), iou)).alias("_m"))
    return best.select("variant", *keys, "label", (-F.col("_m._g")).alias("gt"), F.coalesce("_m.iou", F.lit(0.0)).alias("iou"))


def _sizes(truth: DataFrame, keys: list[str]) -> DataFrame:
    return truth.groupBy(*keys, F.col("label").alias("gt")).agg(F.count("*").alias("_b"))


def rim_ious(pixels: DataFrame, truth: DataFrame, keys: list[str], quantiles=RIM_QUANTILES, cuts=(0.0, 1.0, 2.0), least: int = LEAST_PIXELS) -> DataFrame:
    """``variant_ious`` of ``rim_variants`` where ``pixels`` carry ``gt``, the truth's label there (0: none): counted a pair of
    labels, so that no pixel is listed once a variant.  ``truth``: pixels of the truth (keys, label)."""
    flagged, names = _rim_flags(pixels.select(*keys, "row", "col", "label", "prob", "gt"), keys, quantiles, cuts)
    links = flagged.groupBy(*keys, "label", "gt").agg(F.count("*").alias("_n"), *[F.count_if(f"_on{i}").alias(f"_k{i}") for i in range(len(names))])
    return _best_ious(links, _sizes(truth, keys), keys, names, least)


def label_ious(pixels: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Best truth and IoU of every label: keys, label, gt, iou.  ``pixels`` carry ``gt``, the truth's label there (0: none)."""
    links = pixels.groupBy(*keys, "label", "gt").agg(F.count("*").alias("_n")).withColumn("_k0", F.col("_n"))
    return _best_ious(links, _sizes(truth, keys), keys, ["base"], 0).drop("variant")


def variant_ious(variants: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Best truth and IoU of every label under every variant: variant, keys, label, gt, iou (O212)."""
    place = [*keys, "row", "col"]
    both = variants.join(truth.select(*place, F.col("label").alias("gt")), place).groupBy("variant", *keys, "label", "gt").agg(F.count("*").alias("_i"))
    a = variants.groupBy("variant", *keys, "label").agg(F.count("*").alias("_a"))
    iou = both.join(a, ["variant", *keys, "label"]).join(_sizes(truth, keys), [*keys, "gt"]).withColumn("iou", F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i")))
    best = iou.groupBy("variant", *keys, "label").agg(F.max(F.struct("iou", (-F.col("gt")).alias("_g"))).alias("_m"))
    return a.join(best, ["variant", *keys, "label"], "left").select("variant", *keys, "label", (-F.col("_m._g")).alias("gt"), F.coalesce("_m.iou", F.lit(0.0)).alias("iou"))


def paired_boundary_scores(ious: DataFrame, paired: DataFrame | Column, n_truth: DataFrame, keys: list[str], base: str = "base", above: float = 0.75) -> DataFrame:
    """Macro quality of every variant when only paired labels take it and the others stay ``base`` (O211).

    ``ious``: variant, keys, label, iou; ``paired``: keys, label, or a predicate on them; ``n_truth``: keys, n.  Variant, pq, tp.
    Labels are summed once, to a row a variant and keys, which is kept and read again.
    """
    ensure_checkpoint_dir(ious.sparkSession)
    if isinstance(paired, Column):
        marked = ious.withColumn("_paired", F.coalesce(paired, F.lit(False)))
    else:
        marked = ious.join(paired.select(*keys, "label", F.lit(True).alias("_paired")).distinct(), [*keys, "label"], "left").withColumn("_paired", F.coalesce("_paired", F.lit(False)))
    hit, sums = F.col("iou") > above, []
    for p, of in (("p", F.col("_paired")), ("r", ~F.col("_paired"))):
        sums += [F.count_if(hit & of).alias(f"_tp_{p}"), F.sum(F.when(hit & of, F.col("iou")).otherwise(0.0)).alias(f"_sum_{p}"), F.count_if(of).alias(f"_n_{p}")]
    by = marked.groupBy("variant", *keys).agg(*sums).checkpoint()
    rest = by.where(F.col("variant") == base).select(*keys, "_tp_r", "_sum_r", "_n_r")
    every = n_truth.crossJoin(F.broadcast(by.select("variant").distinct()))
    scored = every.join(by.select("variant", *keys, "_tp_p", "_sum_p", "_n_p"), ["variant", *keys], "left").join(rest, keys, "left").na.fill(0)
    tp, total, n = (F.col(f"_{c}_p") + F.col(f"_{c}_r") for c in ("tp", "sum", "n"))
    pq = F.when(n + F.col("n") > 0, 2 * total / (n + F.col("n"))).otherwise(1.0)
    return scored.groupBy("variant").agg(F.avg(pq).alias("pq"), F.sum(tp).alias("tp"))


def rim_chosen(pixels: DataFrame, choice: DataFrame, keys: list[str], quantiles=RIM_QUANTILES, cuts=(0.0, 1.0, 2.0), least: int = LEAST_PIXELS, base: str = "base") -> DataFrame:
    """``chosen_variant`` of ``rim_variants``: a pixel is asked for its label's variant alone.  ``choice``: keys, label, variant."""
    kept, names = _rim_kept(pixels.select(*keys, "row", "col", "label", "prob"), keys, quantiles, cuts, least)
    taken = kept.join(choice.select(*keys, "label", "variant"), [*keys, "label"], "left")
    on = F.element_at(F.create_map(*[c for i, n in enumerate(names) for c in (F.lit(n), F.col(f"_on{i}"))]), F.coalesce("variant", F.lit(base)))
    return taken.where(on).select(*keys, "row", "col", "label")


def chosen_variant(variants: DataFrame, choice: DataFrame, keys: list[str], base: str = "base") -> DataFrame:
    """The label map in which each label takes its chosen variant, others ``base`` (O213, O214).
    ``choice``: keys, label, variant."""
    picked = variants.join(choice, [*keys, "label", "variant"], "left_semi")
    rest = variants.where(F.col("variant") == base).join(choice.select(*keys, "label"), [*keys, "label"], "left_anti")
    return picked.unionByName(rest).drop("variant")


def reachable_pairs(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Truth pairs both of whose ends are found (O80, O192).  ``truth``: sample_id, iv_gt, ex_gt; sides: sample_id, gt."""
    a, b = left.select("sample_id", F.col("gt").alias("iv_gt")).distinct(), right.select("sample_id", F.col("gt").alias("ex_gt")).distinct()
    return truth.join(a, ["sample_id", "iv_gt"], "left_semi").join(b, ["sample_id", "ex_gt"], "left_semi")
