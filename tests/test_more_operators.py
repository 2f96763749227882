"""Operators of the second round on small fixtures: cell joins, margins, medians, files, decoding, importance."""

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, choices, consensus, instances, kernels, learn
from tessera.operators import matching as mt
from tessera.operators import metrics as ms
from tessera.plans import catalog
from tessera.plans.stages import ensure_checkpoint_dir, report_json
from tessera.sources import images, results, tiff


def poses(spark, seed=1, n=300, same_place=0):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i % 3}", i, float(rng.normal(0, 6)), float(rng.uniform(0, 400)), float(rng.uniform(0, 400)), float(np.round(rng.normal(), 1))) for i in range(n)]
    rows += [("s0", n + i, 0.0, 50.0, 50.0, 9.0 + i) for i in range(same_place)]
    return rows, spark.createDataFrame(rows, "sample_id string, cand_idx long, angle double, land_x double, land_y double, score double")


def test_margins_against_all_pairs(spark):
    rows, df = poses(spark, same_place=40)  # a crowd at one place, better than all others
    want = {}
    for s, i, a, x, y, v in rows:
        rivals = [w for t, j, b, p, q, w in rows if t == s and j != i and (abs(a - b) > 3 or np.hypot(x - p, y - q) > 60)]
        want[i] = v - (max(rivals) if rivals else 0.0)
    got = {r.cand_idx: r.margin for r in mt.margins(df, "score", "margin").collect()}
    assert got == pytest.approx(want)
    alone = mt.margins(df.where("cand_idx = 4"), "score", "margin").first()
    assert alone.margin == alone.score


def test_cells_touch_within_the_width_once(spark):
    rng = np.random.default_rng(2)
    a = [("k", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 20, (60, 2)))]
    left = spark.createDataFrame(a, "k string, i long, x double, y double")
    right = left.select("k", F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    pairs = [tuple(r) for r in cells.neighbours(left, right, ["k"], [("x", "u", 5.0), ("y", "v", 3.0)]).select("i", "j").collect()]
    assert len(pairs) == len(set(pairs))
    assert {(p[1], q[1]) for p in a for q in a if abs(p[2] - q[2]) <= 5 and abs(p[3] - q[3]) <= 3} <= set(pairs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10])
def test_landing_distance_by_hand(spark, n):
    rng = np.random.default_rng(n)
    rows = [("g", f"s{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 9, (n, 2)))]
    got = {r.sample_id: r.dist for r in consensus.landing_distance(spark.createDataFrame(rows, "g string, sample_id string, land_x double, land_y double"), ["g"]).collect()}
    for _, s, x, y in rows:
        others = [(p, q) for _, t, p, q in rows if t != s]
        want = np.hypot(*(np.array([x, y]) - np.median(others, axis=0))) if others else 0.0
        assert got[s] == pytest.approx(want)


def test_no_group_is_joined_with_itself(spark, sf):
    for name in ("vote_modes", "cluster_modes", "consistency_gate", "soft_margin", "gated_choice", "landing_dist"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line and "_cell" not in line]
        # what is left joins a group's one row (statistics, best cells, medians), never its rows with its rows
        assert not any("cand_idx" in line and "_c#" in line for line in joins), name
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_long_chain_of_falling_probabilities(spark):
    ensure_checkpoint_dir(spark)
    rows = [("s", e, e // 2 + e % 2, e // 2, 0.9 - e / 1000) for e in range(200)]
    got = mt.greedy_pairs(spark.createDataFrame(rows, "sample_id string, k long, i long, j long, prob double"), 0.1).collect()
    assert sorted(r.k for r in got) == list(range(0, 200, 2))


def test_modes_follow_their_cut(spark):
    rows = [(f"g{t}", f"{t}{s}{k}", 0, score, 10.0 * k, 100.0 * k, 0.0) for t in range(2) for k, score in ((0, 9.0), (1, 4.0)) for s in range(3)]
    rows += [(g_, s, 1, 0.0, 80.0 + len(s), 900.0, 900.0) for g_, s, *_ in rows]
    c = spark.createDataFrame(rows, "g string, sample_id string, cand_idx long, score double, angle double, land_x double, land_y double")
    got = {(r.g, r.cut): r.modes for r in choices.mode_cut_sweep(c, ["g"]).collect()}
    assert set(got) == {(f"g{t}", c_) for t in range(2) for c_ in choices.MODE_CUTS} and set(got.values()) <= {1, 2}
    assert all(got[("g0", a)] <= got[("g0", b)] for a, b in zip(choices.MODE_CUTS, choices.MODE_CUTS[1:]))


def test_lambda_of_the_others(spark):
    rows = [("a", 0.0, 5), ("a", 1.0, 9), ("b", 0.0, 4), ("b", 1.0, 1), ("c", 0.0, 2), ("c", 1.0, 5)]
    got = {r.subject: (r.lam, r.own, r.others) for r in choices.best_setting_without(spark.createDataFrame(rows, "subject string, lam double, n long"), "lam").collect()}
    assert got == {"a": (0.0, 5, 6), "b": (1.0, 1, 14), "c": (1.0, 5, 10)}


def test_affine_fit_recovers_a_pose_and_refuses_a_line(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (12, 2))
    q = p @ np.array([[0.9, 0.2], [-0.3, 1.1]]).T + (5, -7)
    rows = [("s", *map(float, a), *map(float, b)) for a, b in zip(p, q)] + [("line", float(t), 2.0 * t, float(t), 0.0) for t in range(5)] + [("two", 0.0, 0.0, 1.0, 1.0), ("two", 1.0, 0.0, 1.0, 1.0)]
    got = {r.s: r for r in choices.affine_fit(spark.createDataFrame(rows, "s string, x double, y double, gx double, gy double"), ["s"]).collect()}
    assert [got["s"][n] for n in ("a", "b", "tx", "c", "d", "ty")] == pytest.approx([0.9, 0.2, 5, -0.3, 1.1, -7])
    assert got["line"].a is None and got["two"].a is None


def test_duplicates_fall_to_the_earlier_source(spark):
    pose = lambda a, tx: (a, 0.0, tx, 0.0, 1.0, 0.0)
    rows = [("s", 1, 0, 5.0, pose(1.0, 0.0)), ("s", 0, 1, 5.0, pose(1.008, 4.0)), ("s", 0, 2, 4.0, pose(1.02, 0.0)), ("s", 0, 3, 3.0, pose(1.0, 4.5))]
    c = spark.createDataFrame(rows, "sample_id string, source_rank int, cand_idx long, soft double, pose struct<a:double,b:double,tx:double,c:double,d:double,ty:double>")
    assert [(r.cand_idx, r.place) for r in choices.deduplicated(c).orderBy("place").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float32"])
def test_tiff(spark, tmp_path, kind):
    image = (np.arange(35).reshape(5, 7) * 3).astype(kind)
    assert (tiff.decode(tiff.encode(image)) == image).all() and tiff.decode(tiff.encode(image)).dtype == image.dtype
    folder = tmp_path / "m1" / "r1"
    folder.mkdir(parents=True)
    (folder / "invivo.tif").write_bytes(tiff.encode(image))
    np.save(folder / "exvivo.npy", image)
    got = {(r.modality, r.row, r.col): r.v for r in images.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(m, r, c): float(image[r, c]) for m in ("invivo", "exvivo") for r in range(5) for c in range(7)}
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.decode(b"nothing like it")


def test_exact_result_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b__1", "{}", "{}", "[]"), (0, "a__1", '{"iv_1":"0 2"}', "{}", "[]")], "pos int, sample_id string, invivo_instances string, exvivo_instances string, match_pairs string")
    sizes = spark.createDataFrame([(s, m, 4, 4) for s in ("a__1", "b__1") for m in ("invivo", "exvivo")], "sample_id string, modality string, h int, w int")
    path = tmp_path / "out.csv"
    digest = results.write_exact(rows, str(path), sizes)
    want = io.StringIO(newline="")
    csv.writer(want).writerows([list(results.COLUMNS), ["a__1", '{"iv_1":"0 2"}', "{}", "[]"], ["b__1", "{}", "{}", "[]"]])
    assert path.read_bytes() == want.getvalue().encode() and b"\r\n" in path.read_bytes()
    assert results.write_exact(rows, str(path), sizes) == digest == results.digests(spark, [str(path)]).first().sha256
    assert not (tmp_path / "out.csv.part").exists() and results.read_results(spark, str(path)).count() == 2


def test_exact_file_of_many_parts_equals_the_csv_module(spark, tmp_path):
    odd = ['a,b', 'quote "x"', "line\nbreak", "cr\r", "", " blank ", "é", None]
    rows = [(i, f"s__{i:03d}", odd[i % 8], odd[(i + 3) % 8], odd[(i * 5) % 8]) for i in range(300)]
    df = spark.createDataFrame(rows, "pos int, sample_id string, a string, b string, c string")
    out = io.StringIO(newline="")
    csv.writer(out).writerows(r[1:] for r in rows)
    lines = results.csv_lines(df.repartitionByRange(5, "pos").sortWithinPartitions("pos"), ["sample_id", "a", "b", "c"])
    lines.write.option("lineSep", "\r\n").text(str(tmp_path / "x"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "x").glob("part-*"))) == out.getvalue().encode()


def test_publishing_is_refused_if_a_side_file_changed(spark, tmp_path):
    rows = lambda pairs: spark.createDataFrame([(0, "a__1", '{"i":"0 2"}', '{"e":"0 1"}', pairs)], "pos int, sample_id string, invivo_instances string, exvivo_instances string, match_pairs string")
    sizes = spark.createDataFrame([("a__1", m, 4, 4) for m in ("invivo", "exvivo")], "sample_id string, modality string, h int, w int")
    side, gone, path = tmp_path / "model.bin", tmp_path / "labels.bin", tmp_path / "out.csv"
    side.write_bytes(b"one")
    gone.write_bytes(b"two")
    manifest = results.digests(spark, [str(side), str(gone)]).checkpoint()
    first = results.write_exact(rows("[]"), str(path), sizes, manifest)
    before = path.read_bytes()
    side.write_bytes(b"other")
    with pytest.raises(results.Refused, match="model.bin"):
        results.write_exact(rows('[["i","e"]]'), str(path), sizes, manifest)
    assert path.read_bytes() == before and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["labels.bin", "model.bin", "out.csv"]
    side.write_bytes(b"one")
    assert results.write_exact(rows('[["i","e"]]'), str(path), sizes, manifest) != first and path.read_bytes() != before
    gone.unlink()
    with pytest.raises(results.Refused, match="labels.bin"):
        results.write_exact(rows("[]"), str(path), sizes, manifest)


def test_json_report_repeats(spark):
    df = spark.createDataFrame([(1, "x")], "n int, s string")
    text = report_json("r", {"t": df}, accepted=False)
    assert text == report_json("r", {"t": df}, accepted=False) and json.loads(text) == {"title": "r", "accepted": False, "tables": {"t": [{"n": 1, "s": "x"}]}}


def test_decoding_starts_from_cores_and_bare_bodies():
    body, core = np.zeros((20, 30)), np.zeros((20, 30))
    body[2:9, 2:20] = body[12:18, 4:9] = 1.0
    core[3:8, 3:8] = core[3:8, 14:19] = 0.9  # two cores in one body, none in the other
    core[14, 6] = 0.2
    got = kernels.decode(body, core, low=5)
    assert got.max() == 3 and got[5, 5] != got[5, 16] and (got[12:18, 4:9] == got[14, 6]).all() and ((got > 0) == (body > 0)).all()
    assert kernels.decode(body, core, low=100).max() == 0
    assert kernels.opened(np.eye(5, dtype=bool)).sum() == 0


def test_outlines_follow_the_probability():
    labels, prob = np.zeros((12, 12), int), np.zeros((12, 12))
    labels[4:9, 4:9] = 3
    prob[3:8, 3:8] = 0.9
    got = kernels.redrawn(labels, prob, 0.5)
    assert (got[3:8, 3:8] == 3).all() and got[8, 8] == 0 and got[0, 0] == 0 and got[6, 6] == 3


def test_permuting_keeps_values_and_importance_finds_the_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(u), float(v), int(u > 0)) for i, (u, v) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "k long, u double, v double, y int")
    mixed = learn.permuted(df, "u", "k").orderBy("k").collect()
    assert sorted(r.u for r in mixed) == sorted(r[1] for r in rows) and [r.v for r in mixed] == [r[2] for r in rows] and sum(a.u != b[1] for a, b in zip(mixed, rows)) > 300
    found = learn.importance(df, ["u", "v"], "k", estimator=lambda f, n: learn.trees(f, n, rounds=2))
    assert found[0][0] == "u" and found[0][1] > 0.2 and abs(found[1][1]) < 0.1


def test_hungarian_search_never_pairs_fewer(spark):
    rng = np.random.default_rng(6)
    side = lambda m: spark.createDataFrame([("s", i, float(x), float(y), float(b)) for i, (x, y, b) in enumerate(rng.uniform(0, 40, (m, 3)))], "sample_id string, idx long, x double, y double, brightness double")
    left, right = side(30), side(25)
    of = lambda method: {(r.distance, r.ratio): r.pred for r in ms.match_counts(left, right, F.lit(True), (3.0, 8.0), (0.0,), (0.0,), method).collect()}
    greedy, full = of("greedy"), of("hungarian")
    assert set(greedy) == set(full) and all(full[k] >= greedy[k] for k in full)


def test_variants_keep_small_labels_whole(spark):
    rows = [("s", r, c, 1 if c < 4 else 2, 1.0, float(r)) for r in range(4) for c in (0, 1, 2, 3, 10)]
    px = spark.createDataFrame(rows, "sample_id string, row long, col long, label long, v double, prob double")
    got = {(r.variant, r.label): r.n for r in instances.rim_variants(px, ["sample_id"], least=3).groupBy("variant", "label").agg(F.count("*").alias("n")).collect()}
    assert got[("base", 1)] == 16 and got[("e1", 1)] == 4 and got[("cp2", 1)] == 4
    assert all(got[(v, 2)] == 4 for v, label in got if label == 2 and v in ("e1", "cp2"))  # four pixels, all rim: stays whole
