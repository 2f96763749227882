"""Hand-made fixtures: boundaries, ties, empty sides."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import rle
from tessera.operators import labels as lb
from tessera.operators import learn
from tessera.operators import matching as mt
from tessera.operators import metrics as ms
from tessera.operators import points as pt
from tessera.operators import raster as rs
from tessera.plans.stages import Config, Run, ensure_checkpoint_dir, report
from tessera.sources import images, results

KEY = ["sample_id"]


def grid(spark, *maps):
    rows = [(f"s{n}", r, c, int(p[r][c]), int(t[r][c])) for n, (p, t) in enumerate(maps) for r in range(len(p)) for c in range(len(p[0]))]
    return spark.createDataFrame(rows, "sample_id string, row long, col long, pred long, gt long")


def quality(px):
    ap, ag = lb.areas(px, KEY, "pred"), lb.areas(px, KEY, "gt")
    iou = lb.ious(lb.contingency(px, KEY), ap, ag, KEY)
    return {r.sample_id: r for r in lb.panoptic(iou, ap, ag, px.select(*KEY).distinct(), KEY).collect()}, iou, ap


def test_panoptic_quality_by_hand(spark):
    gt = [[1, 1, 0, 2], [1, 1, 0, 2], [1, 1, 0, 0], [1, 1, 0, 0]]
    pred = [[1, 1, 0, 2], [1, 1, 0, 0], [1, 1, 0, 0], [1, 0, 0, 0]]
    empty = [[0] * 4] * 4
    three = [[1, 1, 1, 0]]
    got, iou, ap = quality(grid(spark, (pred, gt), (gt, gt), (empty, gt), (empty, empty), (three, [[1, 1, 1, 1]])))
    assert [(got[f"s{i}"].tp, got[f"s{i}"].fp, got[f"s{i}"].fn) for i in range(5)] == [(1, 1, 1), (2, 0, 0), (0, 0, 2), (0, 0, 0), (0, 1, 1)]
    assert [got[f"s{i}"].pq for i in range(4)] == [0.4375, 1.0, 0.0, 1.0]
    links = {(r.sample_id, r.pred): r.link for r in lb.gt_links(iou, ap, KEY).collect()}
    assert links[("s0", 1)] == 1 and links[("s0", 2)] == -1 and links[("s4", 1)] == -1  # 0.75 is no match


def test_pair_scores_by_hand(spark):
    link = lambda rows, c: spark.createDataFrame(rows, f"sample_id string, {c} long, link long")
    iv = link([("A", 0, 0), ("A", 1, -1), ("A", 2, 1), ("B", 0, 0)], "i")
    ex = link([("A", 0, 1), ("A", 1, 0), ("A", 2, -1), ("B", 0, 0)], "j")
    truth = spark.createDataFrame([("A", 0, 1), ("A", 2, 0), ("B", 0, 0)], "sample_id string, gt_i long, gt_j long")
    pred = spark.createDataFrame([("A", 0, 0), ("A", 1, 1), ("A", 2, 1), ("B", 0, 0)], "sample_id string, i long, j long")
    hits = {(r.sample_id, r.i, r.j): r.tp for r in ms.true_pairs(pred, iv, ex, truth).collect()}
    assert hits[("A", 0, 0)] and not hits[("A", 1, 1)] and hits[("B", 0, 0)]
    rows = spark.createDataFrame([("m", "A", 1, 3, 3, True, False), ("m", "B", 1, 1, 1, True, False)], "subject string, sample_id string, tp long, pred long, n_gt long, kept boolean, wrong boolean")
    pooled = ms.pair_f1(rows).where("subject IS NULL").first()
    assert (pooled.tp, pooled.fp, pooled.fn, pooled.f1) == (2, 2, 2, 0.5)
    gated = ms.pair_f1(rows.withColumn("kept", F.col("sample_id") == "B")).where("subject IS NULL").first()
    assert (gated.tp, gated.fp, gated.fn) == (1, 0, 3) and gated.f1 == pytest.approx(0.4)
    none = rows.selectExpr("subject", "sample_id", "0L tp", "0L pred", "0L n_gt", "kept", "wrong")
    assert ms.pair_f1(none).where("subject IS NULL").first().f1 == 0.0


def sequential(edges, threshold):
    used_i, used_j, out = set(), set(), set()
    for k, i, j, p in sorted(edges, key=lambda e: (-e[3], e[0])):
        if p >= threshold and i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.add(k)
    return out


def test_greedy_rounds_equal_the_sequential_rule(spark):
    ensure_checkpoint_dir(spark)
    rng, rows, want = random.Random(3), [], set()
    for s in range(12):
        edges = [(k, rng.randint(0, 6), rng.randint(0, 6), rng.choice([0.1, 0.2, 0.2, 0.5, 0.9])) for k in range(20)]
        rows += [(f"s{s}", *e) for e in edges]
        want |= {(f"s{s}", k) for k in sequential(edges, 0.15)}
    rows += [("h", k, i, j, p) for k, (i, j, p) in enumerate([(0, 0, 0.5), (0, 1, 0.9), (1, 1, 0.6), (2, 2, 0.4), (3, 2, 0.4)])]
    got = mt.greedy_pairs(spark.createDataFrame(rows, "sample_id string, k long, i long, j long, prob double"), 0.15)
    found = {(r.sample_id, r.k) for r in got.collect()}
    assert found == want | {("h", 1), ("h", 3)}


def test_threshold_and_gate_ties(spark):
    pairs = spark.createDataFrame([("a", 0.2, True), ("a", 0.01, False), ("b", 0.9, True)], "sample_id string, prob double, y boolean")
    table = {r.threshold: (r.tp, r.pred, r.f1) for r in ms.threshold_table(pairs, 3).collect()}
    assert table[0.0] == (2, 3, pytest.approx(4 / 6)) and table[0.2][:2] == (2, 2)
    best = ms.best_threshold(ms.threshold_table(pairs, 3)).first()
    assert (best.threshold, best.tp, best.pred, best.f1) == (0.025, 2, 2, pytest.approx(0.8))
    taus = [(i * 0.05, 3 if i < 5 else 0, 0.5 if i in (3, 8) else 0.1) for i in range(21)]
    choice = ms.gate_choice(spark.createDataFrame(taus, "tau double, wrong int, f1 double")).first()
    assert (round(choice.conservative, 2), round(choice.aggressive, 2)) == (0.25, 0.40)
    flat = ms.gate_choice(spark.createDataFrame([(t, 1, 0.3) for t, _, _ in taus], "tau double, wrong int, f1 double")).first()
    assert flat.conservative is None and flat.aggressive == 1.0


def test_ranking_and_unlock(spark):
    rows = [("a", True, 0.55, 0.50, 1), ("b", True, 0.56, 0.49, 0), ("c", True, 0.55, 0.51, 3), ("d", True, 0.55, 0.50, 0), ("r", False, 0.9, 0.9, 0)]
    ranked = ms.rank_configs(spark.createDataFrame(rows, "name string, accepted boolean, full double, f1 double, kept_wrong int"))
    assert [r.name for r in ranked.orderBy("place").collect()] == ["b", "c", "d", "a"]
    n = lambda rows: spark.createDataFrame(rows, "sample_id string, n_pairs long")
    assert {r.sample_id: r.newly_unlocked for r in ms.unlock_table(n([("x", 0), ("y", 4)]), n([("x", 3), ("y", 4)])).collect()} == {"x": True, "y": False}
    target = spark.range(1).select(ms.accepted(F.lit(0.5), F.lit(0.5)), ms.accepted(F.lit(0.5 + 1e-12), F.lit(0.5)), ms.accepted(F.lit(0.5 - 1e-9), F.lit(0.5))).first()
    assert tuple(target) == (False, True, False)


def test_neighbour_bounds(spark):
    p = lambda rows: spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "sample_id string, idx long, x double, y double")
    a, b = p([(0, 0), (3, 4)]), p([(5, 0), (3, -1)])
    assert {(r.i, r.j) for r in pt.within(a, b, 5.0).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {(r.i, r.j) for r in pt.within(a, b, 5.0, inclusive=False).collect()} == {(0, 1), (1, 0)}
    far = p([(-50, 0)])
    assert pt.nearest_pairs(far, b, 5.0).count() == 0 and pt.seeds(far, b, 5.0).count() == 1 and pt.retained(far, b, 5.0).count() == 0
    dim = b.withColumn("brightness", F.col("idx").cast("double"))
    assert pt.bright_or_all(dim, 1.0).count() == 2  # fewer than three are bright


def test_rle_round_trip_and_errors(spark):
    masks = [("s", "iv", "a", "0 3 10 2"), ("s", "iv", "b", "2 2"), ("s", "iv", "c", "5"), ("s", "iv", "d", ""), ("s", "iv", "e", "x 1"), ("s", "ex", "f", "14 3"), ("s", "ex", "g", "0 0")]
    t = spark.createDataFrame(masks, "sample_id string, modality string, cell_id string, rle string")
    sizes = spark.createDataFrame([("s", "iv", 4, 4), ("s", "ex", 4, 4)], "sample_id string, modality string, h int, w int")
    assert {(r.cell_id, r.error) for r in rle.problems(t, sizes).collect()} == {("b", "overlap"), ("c", "odd"), ("d", "empty"), ("e", "number"), ("f", "bounds"), ("g", "length")}
    spread = rle.to_positions(t.where("cell_id = 'a'").select("cell_id", F.inline(rle.runs(F.col("rle")))), ["cell_id"])
    assert sorted(r.pos for r in spread.collect()) == [0, 1, 2, 10, 11]
    assert rle.to_text(rle.from_positions(spread, ["cell_id"]), ["cell_id"]).first().rle == "0 3 10 2"


def test_runs_give_the_pixels_overlap(spark):
    rng = np.random.default_rng(4)
    runs = lambda: [("s", int(rng.integers(1, 6)), int(s), int(rng.integers(1, 150))) for s in rng.integers(0, 1000, 40)]
    a, b = runs(), runs()
    want = {}
    for _, p, s, n in a:
        for _, q, t, m in b:
            o = min(s + n, t + m) - max(s, t)
            if o > 0:
                want[(p, q)] = want.get((p, q), 0) + o
    df = lambda r: spark.createDataFrame(r, "sample_id string, label long, start long, len long")
    assert {(r.pred, r.gt): r.inter for r in lb.interval_overlap(df(a), df(b), KEY).collect()} == want


def test_grow_takes_the_larger_neighbour(spark):
    canvas = spark.createDataFrame([("s", 0, c, float(c)) for c in range(5)], "sample_id string, row long, col long, prob double")
    px = spark.createDataFrame([("s", 0, 1, 4), ("s", 0, 3, 2)], "sample_id string, row long, col long, label long")
    assert {(r.col, r.label) for r in rs.grow(px, canvas, KEY).collect()} == {(0, 4), (1, 4), (2, 4), (3, 2), (4, 2)}
    assert {r.col for r in rs.grow(px, canvas, KEY, above=2.0).collect()} == {1, 3, 4}


def test_pose_expressions(spark):
    m = g.pose((0.9, -0.2, 5.0, 0.3, 1.1, -4.0))
    got = spark.range(1).select(g.angle(m).alias("a"), g.scale(m).alias("s"), g.anisotropy(m).alias("n"), g.move_x(m, F.lit(2.0), F.lit(3.0)).alias("x"), g.compose(m, m).alias("c")).first()
    linear = np.array([[0.9, -0.2], [0.3, 1.1]])
    s = np.linalg.svd(linear, compute_uv=False)
    assert got.a == pytest.approx(np.degrees(np.arctan2(0.3, 0.9))) and got.s == pytest.approx(np.sqrt(np.linalg.det(linear))) and got.n == pytest.approx(s[0] / s[1] - 1) and got.x == pytest.approx(0.9 * 2 - 0.2 * 3 + 5)
    whole = np.r_[np.c_[linear, [5.0, -4.0]], [[0, 0, 1]]]
    assert list(got.c) == pytest.approx((whole @ whole)[:2].ravel().tolist())


def test_folds_never_see_their_subject(spark):
    rows = spark.createDataFrame([(f"m{i % 3}", float(i % 7), float("nan") if i % 5 == 0 else float(i % 4), int(i % 7 > 3) if i % 3 else None) for i in range(90)], "subject string, u double, v double, y int")
    seen = []

    def spy(features, n):
        seen.append(n)
        return learn.verifier(features, n)

    out = learn.leave_one_out(rows, ["u", "v"], spy, exclude=("m2",))
    got = out.groupBy("subject").agg(F.count("*").alias("n"), F.max("prob").alias("top")).orderBy("subject").collect()
    assert [(r.subject, r.n) for r in got] == [("m0", 30), ("m1", 30), ("m2", 30)] and got[2].top == 0.0
    assert seen == [30]  # m0 is unlabelled: only m0's fold has both classes to learn from
    assert learn.fit(rows.where("y = 1"), ["u", "v"]) == 1.0 and learn.fit(rows.limit(0), ["u", "v"]) == 0.0


def test_result_file(spark, tmp_path):
    expected = spark.createDataFrame([("b__1", 0), ("a__1", 1)], "sample_id string, pos int")
    cells = spark.createDataFrame([("b__1", "invivo", 0, "iv_1", "0 2"), ("b__1", "invivo", 1, "iv_0", "4 1"), ("b__1", "exvivo", 0, "ex_0", "3 3")], "sample_id string, modality string, idx int, cell_id string, rle string")
    pairs = spark.createDataFrame([("b__1", "iv_1", "ex_0")], "sample_id string, iv_id string, ex_id string")
    sizes = spark.createDataFrame([(s, m, 4, 4) for s in ("a__1", "b__1") for m in ("invivo", "exvivo")], "sample_id string, modality string, h int, w int")
    rows = results.assemble(expected, cells, pairs)
    results.write_results(rows, f"{tmp_path}/out", sizes)
    back = results.read_results(spark, f"{tmp_path}/out")
    assert [r.sample_id for r in back.collect()] == ["b__1", "a__1"] and back.collect()[1].match_pairs == "[]"
    assert [(r.idx, r.cell_id, r.rle) for r in results.instances(back).where("modality = 'invivo'").orderBy("idx").collect()] == [(0, "iv_1", "0 2"), (1, "iv_0", "4 1")]
    assert [tuple(r) for r in results.pairs(back).collect()] == [("b__1", "iv_1", "ex_0")]
    assert results.differs(back, back, ["match_pairs"]).count() == 0
    bad = results.assemble(expected, cells, pairs.unionByName(spark.createDataFrame([("b__1", "iv_1", "ex_9")], pairs.schema)))
    with pytest.raises(ValueError, match="used twice"):
        results.write_results(bad, f"{tmp_path}/bad", sizes)
    assert results.sample_ids(spark, f"{tmp_path}/nothing").count() == 0


def test_images(spark, tmp_path):
    folder = tmp_path / "m1" / "r1"
    folder.mkdir(parents=True)
    np.save(folder / "invivo.npy", np.arange(6).reshape(2, 3))
    px = images.read_pixels(spark, str(tmp_path))
    assert {(r.sample_id, r.modality, r.row, r.col, r.v) for r in px.collect()} == {("m1__r1", "invivo", i // 3, i % 3, float(i)) for i in range(6)}
    assert [r.sample_id for r in images.regions(spark, str(tmp_path)).collect()] == ["m1__r1"]
    assert images.missing_inputs(spark, [str(folder), f"{folder}/x"]) == [f"{folder}/x"]
    np.save(folder / "exvivo.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="3 dimensions"):
        images.read_pixels(spark, str(tmp_path)).collect()


def test_stages_resume_and_notice_changes(spark, tmp_path):
    assert Config(sigma=2).fingerprint() == Config(sigma=2.0).fingerprint() != Config().fingerprint()
    with pytest.raises(ValueError, match="sigma.*lambda"):
        Run(spark, str(tmp_path), Config(sigma=0, lambdas=(-1.0,)))
    run, calls = Run(spark, str(tmp_path), Config()), []

    def double(df):
        calls.append(1)
        return df.select((F.col("id") * 2).alias("id"))

    run.ensure("prep", lambda: spark.range(5))
    assert run.ensure("scan", double, "prep").count() == 5 and run.ensure("scan", double, "prep").count() == 5 and len(calls) == 1
    spark.range(1).write.mode("append").parquet(f"{run.folder}/scan")
    with pytest.raises(ValueError, match="differs"):
        run.load("scan")
    with pytest.raises(FileNotFoundError):
        run.load("joint")
    assert "| 5 |" in report("r", {"t": spark.range(5).agg(F.count("*").alias("n"))})
