import math

import numpy as np
import pandas as pd

from tessera.llm import op10_search as s


def brute(frame):
    rows = [(int(i), np.array([float(x) for x in v])) for i, v in zip(frame.vec_id, frame.embedding) if i == i and i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float((v * w).sum()), i) for i, w in rows if i != q))[:20]
    return out


def compare(got, want):
    assert set(got.query_id) == {q for q, found in want.items() if found}
    hits = total = 0
    for q, rows in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        assert rows["rank"].tolist() == list(range(1, len(want[q]) + 1))
        assert list(zip(-rows.score, rows.vec_id)) == sorted(zip(-rows.score, rows.vec_id))
        known = {i: -x for x, i in want[q]}
        hits += sum(i in known for i in rows.vec_id)
        total += len(known)
        for i, x in zip(rows.vec_id, rows.score):
            assert i not in known or abs(known[i] - x) < 1e-12
    assert hits >= 0.9 * total
    return hits / total


def test_recall(spark, sf):
    recall = compare(s.op10_collision_counting(spark, sf).toPandas(), brute(pd.read_parquet(f"{sf}/embeddings.parquet")))
    print("recall", recall)


def test_many_blocks_and_odd_rows(spark, sf, tmp_path, monkeypatch):
    base = pd.read_parquet(f"{sf}/embeddings.parquet").head(300)
    rows = [(int(i), [float(x) for x in v], "clash", 1.0) for i, v in zip(base.vec_id, base.embedding)]
    rows += [(1000, None, "", 1.0), (1020, [0.0] * 64, "", 1.0), (1040, [float("nan")] * 64, "", 1.0), (1060, [None] + [1.0] * 63, "", 1.0), (1080, [1.0] * 3, "", 1.0), (1100, [], "", 1.0), (1120, [float("inf")] * 64, "", 1.0)]
    rows += [(None, [1.0] * 64, "", 1.0), (1140, [3.0 * x for x in rows[5][1]], "", 1.0), (2001, rows[6][1], "", 1.0), (2002, rows[6][1], "", 1.0), rows[20]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, score double").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(s, "BLOCK", 60)
    monkeypatch.setattr(s, "QUERIES_AT_ONCE", 5)
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "v", "score"], dtype=object)
    want = brute(frame.drop_duplicates("vec_id"))
    got = s.op10_collision_counting(spark, str(tmp_path)).toPandas()
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 20).all()
    hits = [len(set(found.vec_id) & {i for _, i in want[q]}) / 20 for q, found in got.groupby("query_id")]
    assert np.mean(hits) >= 0.9


def test_few_and_none(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    for name, rows in (("none", []), ("one", [(20, [1.0, 2.0])]), ("three", [(20, [1.0, 0.0]), (21, [0.5, 0.1]), (22, [0.5, 0.1])])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    assert s.op10_collision_counting(spark, f"{tmp_path}/none").count() == 0
    assert s.op10_collision_counting(spark, f"{tmp_path}/one").count() == 0
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in s.op10_collision_counting(spark, f"{tmp_path}/three").orderBy("rank").collect()] == [(20, 1, 21, 0.5), (20, 2, 22, 0.5)]


def test_growing_windows_count_as_fresh_ones():
    rng = np.random.default_rng(7)
    block = s.Block(rng.normal(size=(500, 16)), 9.0)
    at = block.flat.reshape(s.PROJECTIONS, -1) - block.shift[:, None]
    for q in rng.normal(size=(6, 16)):
        here = block.directions[:, :16] @ (q / np.sqrt(q @ q))
        low, high = block.window(here, 0.2)
        counts = block.collisions(low, high)
        for radius in (0.21, 0.5, 0.9, 3.0, 40.0):
            wider = block.window(here, radius)
            counts += block.entered(low, high, *wider)
            low, high = wider
            plain = np.zeros(500, int)
            for p in range(s.PROJECTIONS):
                plain[block.order[p][np.abs(at[p] - here[p]) <= radius]] += 1
            assert (counts == plain).all() and (block.collisions(low, high) == plain).all()
        assert (counts == s.PROJECTIONS).all()


def test_each_length_is_searched_by_itself(spark, tmp_path):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [9.0, 9.0, 9.0]), (40, [1.0, 1.0, 0.0]), (3, [2.0, 0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in s.op10_collision_counting(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 0.5), (40, 1, 2, 18.0), (40, 2, 3, 2.0)]
