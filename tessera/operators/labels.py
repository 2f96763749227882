"""Label maps: contingency, overlap of runs, IoU links, panoptic quality, relabelling, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``pixels``: keys, pred, gt a pixel.  Pixels shared by each pair of labels > 0."""
    return pixels.where("pred > 0 AND gt > 0").groupBy(*keys, "pred", "gt").agg(F.count("*").alias("inter"))


def areas(pixels: DataFrame, keys: list[str], side: str) -> DataFrame:
    return pixels.where(f"{side} > 0").groupBy(*keys, side).agg(F.count("*").alias(f"area_{side}"))


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 64) -> DataFrame:
    """The same from runs: ``label``, ``start``, ``len`` on both sides.

    Runs are listed in every ``bucket``-wide cell they touch; a pair is counted only in the cell where its
    overlap starts, so the equi-join on the cell counts it once.
    """
    spread = lambda t, p: t.select(
        *keys, F.col("label").alias(p), F.col("start").alias(f"_s{p}"), (F.col("start") + F.col("len")).alias(f"_e{p}"),
        F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("len") - 1) / bucket))).alias("_cell"),
    )
    a, b = spread(left.where("len > 0"), "pred"), spread(right.where("len > 0"), "gt")
    start, end = F.greatest("_spred", "_sgt"), F.least("_epred", "_egt")
    met = a.join(b, [*keys, "_cell"]).where((start < end) & (F.floor(start / bucket) == F.col("_cell")))
    return met.groupBy(*keys, "pred", "gt").agg(F.sum(end - start).alias("inter"))


def ious(inter: DataFrame, area_pred: DataFrame, area_gt: DataFrame, keys: list[str]) -> DataFrame:
    out = inter.join(area_pred, [*keys, "pred"]).join(area_gt, [*keys, "gt"])
    return out.withColumn("iou", F.col("inter") / (F.col("area_pred") + F.col("area_gt") - F.col("inter")))


def gt_links(iou: DataFrame, area_pred: DataFrame, keys: list[str], above: float = 0.75) -> DataFrame:
    """Every predicted label with the truth it matches at IoU strictly above, else -1."""
    hits = iou.where(F.col("iou") > above).groupBy(*keys, "pred").agg(F.max_by("gt", "iou").alias("link"))
    return area_pred.select(*keys, "pred").join(hits, [*keys, "pred"], "left").select(*keys, "pred", F.coalesce("link", F.lit(-1)).alias("link"))


def best_iou(iou: DataFrame, area: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Largest IoU of every label of ``side``, 0 without overlap."""
    top = iou.groupBy(*keys, side).agg(F.max("iou").alias("best"))
    return area.select(*keys, side).join(top, [*keys, side], "left").select(*keys, side, F.coalesce("best", F.lit(0.0)).alias("best"))


def panoptic(iou: DataFrame, area_pred: DataFrame, area_gt: DataFrame, samples: DataFrame, keys: list[str], above: float = 0.75) -> DataFrame:
    """tp, fp, fn, pq, mean IoU of matches and near misses (0.5 to ``above``) of each row of ``samples``.

    Both sides empty: 1; one side: 0 (O65, O67).
    """
    hit = F.col("iou") > above
    matched = iou.groupBy(*keys).agg(F.count_if(hit).alias("tp"), F.sum(F.when(hit, F.col("iou")).otherwise(0.0)).alias("_sum"), F.count_if((F.col("iou") >= 0.5) & ~hit).alias("near_miss"))
    n = lambda t, name: t.groupBy(*keys).agg(F.count("*").alias(name))
    out = samples.join(matched, keys, "left").join(n(area_pred, "_p"), keys, "left").join(n(area_gt, "_g"), keys, "left").na.fill(0, ["tp", "_sum", "near_miss", "_p", "_g"])
    tp, p, gt = F.col("tp"), F.col("_p"), F.col("_g")
    pq = F.when((p == 0) & (gt == 0), 1.0).when((p == 0) | (gt == 0), 0.0).otherwise(2 * F.col("_sum") / F.nullif(p + gt, F.lit(0)))
    return out.select(*keys, "tp", (p - tp).alias("fp"), (gt - tp).alias("fn"), pq.alias("pq"), F.try_divide("_sum", "tp").alias("mean_iou"), "near_miss")


def panoptic_multi(iou: DataFrame, area_pred: DataFrame, area_gt: DataFrame, keys: list[str], above: float = 0.75) -> DataFrame:
    """Quality of overlapping hypotheses submitted together: each truth is hit once, by its best."""
    best = iou.where(F.col("iou") > above).groupBy(*keys, "gt").agg(F.max("iou").alias("iou"))
    matched = best.groupBy(*keys).agg(F.count("*").alias("tp"), F.sum("iou").alias("_sum"))
    p = area_pred.groupBy(*keys).agg(F.count("*").alias("_p"))
    gt = area_gt.groupBy(*keys).agg(F.count("*").alias("_g"))
    out = gt.join(p, keys, "left").join(matched, keys, "left").na.fill(0)
    return out.select(*keys, "tp", (2 * F.col("_sum") / (F.col("_p") + F.col("_g"))).alias("pq"))


def relabel(pixels: DataFrame, keys: list[str], label: str = "label", out: str = "dense") -> DataFrame:
    """Consecutive ids from 1 in ascending order of the labels > 0; 0 stays.

    The distinct labels are ranked, not the pixels.
    """
    ids = pixels.where(F.col(label) > 0).select(*keys, label).distinct()
    ids = ids.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(label)))
    return pixels.join(ids, [*keys, label], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def size_gate(pixels: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Pixels of labels whose area is in [low, high]."""
    kept = pixels.where("label > 0").groupBy(*keys, "label").count().where(F.col("count").between(low, high))
    return pixels.join(kept, [*keys, "label"], "left_semi")


def fuse(base: DataFrame, added: DataFrame, keys: list[str], most_overlap: float = 0.0) -> DataFrame:
    """``base`` and those instances of ``added`` that overlap it by at most that share; ids follow on.

    Both: keys, row, col, label > 0.  A base pixel wins.
    """
    pixel = [*keys, "row", "col"]
    taken = base.select(*pixel, F.lit(1).alias("_base"))
    marked = added.join(taken, pixel, "left")
    share = marked.groupBy(*keys, "label").agg((F.count("_base") / F.count("*")).alias("_share")).where(F.col("_share") <= most_overlap)
    top = base.groupBy(*keys).agg(F.max("label").alias("_top"))
    fresh = marked.where("_base IS NULL").join(share, [*keys, "label"], "left_semi")
    fresh = fresh.join(top, keys, "left").select(*pixel, (F.col("label") + F.coalesce("_top", F.lit(0))).alias("label"))
    return base.select(*pixel, "label").unionByName(fresh)


def setting_grid(pixels: DataFrame, keys: list[str], settings: dict[str, str]) -> DataFrame:
    """Mean quality of several ways to make the predicted labels (O135): each setting is an SQL condition
    under which a pixel keeps its label; one plan scores all of them.  ``pixels``: keys, label, gt."""
    listed = F.array(*[F.struct(F.lit(n).alias("setting"), F.expr(c).alias("_on")) for n, c in settings.items()])
    spread = pixels.select(*keys, "label", "gt", F.inline(listed)).withColumn("pred", F.when(F.col("_on"), F.col("label")).otherwise(F.lit(0)))
    by = ["setting", *keys]
    ap, ag = areas(spread, by, "pred"), areas(spread, by, "gt")
    scored = panoptic(ious(contingency(spread, by), ap, ag, by), ap, ag, spread.select(*by).distinct(), by)
    return scored.groupBy("setting").agg(F.avg("pq").alias("pq"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def agreement(pixels: DataFrame, keys: list[str], above: float = 0.5) -> DataFrame:
    """Two label maps of the same images (pred, gt): labels on each side and those that find a partner."""
    ap, ag = areas(pixels, keys, "pred"), areas(pixels, keys, "gt")
    close = ious(contingency(pixels, keys), ap, ag, keys).where(F.col("iou") > above)
    met = close.groupBy(*keys).agg(F.count_distinct("pred").alias("pred_met"), F.count_distinct("gt").alias("gt_met"))
    out = pixels.select(*keys).distinct()
    for side, table in (("pred", ap), ("gt", ag)):
        out = out.join(table.groupBy(*keys).agg(F.count("*").alias(f"n_{side}")), keys, "left")
    return out.join(met, keys, "left").na.fill(0)
