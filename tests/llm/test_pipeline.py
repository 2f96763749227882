import hashlib
from collections import Counter

import pytest

import corpus_pipeline as c
from tessera.llm import op1_mix, op5_resample, op8_pack
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_passages import brute
from tests.llm.util import frame, words


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in c.STAGES:
        folder = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_columns(steps):
    assert len(c.STAGES) == 5 and all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage_follows_its_operator_and_keeps_clean_documents(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    decided = op5_resample.resample(steps[0], labels)[0].toPandas()
    assert ids(steps[1]) == Counter(decided[decided.kept].doc_id)
    known = labels.toPandas()
    clean = set(known[(known.quality == 1) & (known.toxic == 0)].doc_id) & set(ids(steps[0]))
    assert len(clean & set(ids(steps[1]))) >= 0.97 * len(clean) and steps[1].count() < steps[0].count()


def test_near_dedup_stage_against_brute_force(steps):
    assert ids(steps[2]) == plain_kept([(r.doc_id, r.text) for r in steps[1].collect()])


def test_substring_stage_against_brute_force(steps):
    want = {(d, sha) for d, n, gone, sha in brute([(r.doc_id, r.text) for r in steps[2].collect()]) if not gone or gone < n}
    got = {(r.doc_id, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in steps[3].collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in steps[3].collect() if r.text is not None)


def test_mix_stage(steps):
    taken = op1_mix.mix(steps[3]).toPandas()
    assert ids(steps[4]) == Counter({r.doc_id: r.copies for r in taken.itertuples() if r.copies})


def test_pack_stage(steps):
    got, pieces = steps[5].toPandas(), op8_pack.pieces(steps[4]).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got[key].values)) == Counter(map(tuple, pieces[key].values))
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 2048) * 1.02 + 2


def test_odd_rows_go_through_every_stage(spark, sf):
    docs = frame(spark)
    given = ids(docs)
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf)
        got = ids(out)
        assert got and set(got) <= set(given), name
        if stage not in (c.mixing, c.packing):
            assert not got - given and out.columns == docs.columns, name
            # columns whose names clash with the operators' own come through unchanged
            assert {tuple(r) for r in out.select("doc_id", "size", "target", "_b", "length").collect()} <= {tuple(r) for r in docs.select("doc_id", "size", "target", "_b", "length").collect()}
    empty = frame(spark, [])
    for name, stage in c.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run(spark, sf, steps):
    assert c.run(spark, sf).count() == steps[5].count()
    assert c.ORACLE_SQL is None
