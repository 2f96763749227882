from pyspark.sql import functions as F

from tessera.plans import builds
from tessera.plans.builds import Build

ROWS = [("a", f"r{i}", j, float(i * j)) for i in range(4) for j in range(3)] + [("b", f"q{i}", j, float(i + j)) for i in range(3) for j in range(2)]
SCHEMA = "subject string, sample_id string, idx long, v double"


def run(spark, root, rows, calls=None):
    """Regions, their subjects, and regions again with what their subject says."""
    seen = lambda name: lambda df: calls.setdefault(name, []).append(sorted(r[0] for r in df.select(KEY[name]).distinct().collect())) if calls is not None else None

    def watched(name, f):
        def compute(df):
            seen(name)(df)
            return f(df)

        return compute

    df, build = spark.createDataFrame(rows, SCHEMA), Build(spark, root)
    regions = build.step("regions", df, ["sample_id"], watched("regions", lambda x: x.groupBy("sample_id").agg(F.first("subject").alias("subject"), F.sum("v").alias("total"))))
    subjects = build.step("subjects", regions, ["subject"], watched("subjects", lambda x: x.groupBy("subject").agg(F.max("total").alias("most"))))
    both = build.step("shares", regions.join(subjects, "subject"), ["sample_id"], watched("shares", lambda x: x.select("sample_id", "subject", (F.col("total") / F.col("most")).alias("share"))))
    return build, sorted(map(tuple, both.collect()))


KEY = {"regions": "sample_id", "subjects": "subject", "shares": "sample_id"}


def plain(rows):
    total, of = {}, {}
    for s, r, _, v in rows:
        total[r], of[r] = total.get(r, 0) + v, s
    most = {s: max(t for r, t in total.items() if of[r] == s) for s in of.values()}
    return sorted((r, of[r], total[r] / most[of[r]]) for r in total)


def test_only_what_changed_is_computed_again(spark, tmp_path):
    root = str(tmp_path / "build")
    build, got = run(spark, root, ROWS)
    assert got == plain(ROWS) and build.work == {"regions": 7, "subjects": 2, "shares": 7}
    build, got = run(spark, root, list(reversed(ROWS)))
    assert got == plain(ROWS) and build.work == {"regions": 0, "subjects": 0, "shares": 0}
    # a region below the largest of its subject: itself, its subject, and itself again
    changed, calls = [(s, r, i, v + 0.5 * (r == "r1")) for s, r, i, v in ROWS], {}
    build, got = run(spark, root, changed, calls)
    assert got == plain(changed) and build.work == {"regions": 1, "subjects": 1, "shares": 1}
    assert calls == {"regions": [["r1"]], "subjects": [["a"]], "shares": [["r1"]]}
    # the largest: all regions of its subject have another share; the other subject is left alone
    changed, calls = [(s, r, i, v + 0.5 * (r == "r3")) for s, r, i, v in changed], {}
    build, got = run(spark, root, changed, calls)
    assert got == plain(changed) and calls["shares"] == [["r0", "r1", "r2", "r3"]] and calls["subjects"] == [["a"]]
    # going back to old rows computes again what the last run no longer holds, new and lost regions appear and vanish
    fewer = [x for x in changed if x[1] != "q2"] + [("b", "q9", 0, 8.0)]
    build, got = run(spark, root, fewer)
    assert got == plain(fewer) and build.work["regions"] == 1
    fewer = [x for x in fewer if x[1] != "q0"]
    build, got = run(spark, root, fewer)
    assert got == plain(fewer) and build.work["regions"] == 0


def test_an_interrupted_run_leaves_the_state_before_it(spark, tmp_path):
    root, rows = str(tmp_path / "build"), spark.createDataFrame(ROWS, SCHEMA)
    count = lambda x: x.groupBy("sample_id").agg(F.count("*").alias("n"))
    first = sorted(map(tuple, Build(spark, root).step("n", rows, ["sample_id"], count).collect()))

    def broken(df):
        return count(df).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))

    more = rows.unionByName(spark.createDataFrame([("c", "z", 0, 1.0)], SCHEMA))
    try:
        Build(spark, root).step("n", more, ["sample_id"], broken)
        raise AssertionError
    except Exception as e:
        assert "lost" in str(e)
    build = Build(spark, root)
    assert sorted(map(tuple, build.step("n", rows, ["sample_id"], count).collect())) == first and build.work["n"] == 0
    assert build.step("n", more, ["sample_id"], count).count() == len(first) + 1 and build.work["n"] == 1
    assert build.step("n", more, ["sample_id"], count, version="2").count() == len(first) + 1 and build.work["n"] == len(first) + 1


def test_many_generations_become_one_and_null_keys_are_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(builds, "MANY", 2)
    root = str(tmp_path / "build")
    for turn in range(5):
        rows = [(None, None, turn, 1.0), *ROWS[: 3 * (turn % 4 + 1)]]
        build = Build(spark, root)
        got = build.step("n", spark.createDataFrame(rows, SCHEMA), ["sample_id"], lambda x: x.groupBy("sample_id").agg(F.sum("idx").alias("n")))
        want = {}
        for _, r, i, _ in rows:
            want[r] = want.get(r, 0) + i
        assert {r.sample_id: r.n for r in got.collect()} == want and build.work["n"] >= 1
    empty = spark.createDataFrame([], SCHEMA)
    assert Build(spark, root).step("n", empty, ["sample_id"], lambda x: x.groupBy("sample_id").agg(F.sum("idx").alias("n"))).count() == 0
