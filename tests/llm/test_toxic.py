import random

import numpy as np
import pandas as pd

from tessera.llm import op5_resample as o5
from tests.llm.util import frame


def made(n=240):
    """Long texts of plain words; every third document holds one passage of a few insults, half of them labelled."""
    rng = random.Random(4)
    plain, bad = [f"w{i}" for i in range(60)], ["scum", "moron", "idiot"]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(plain, k=900)
        if i % 3 == 0:
            at = rng.randint(0, 890)
            text[at : at + 6] = rng.choices(bad, k=6)
        rows.append((i, " ".join(text), "en", "a", None, 7, 0.5, "x", 3))
        if i < n // 2:
            labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_a_toxic_passage_in_a_long_text_is_rejected(spark):
    rows, labels = made()
    got = o5.resample(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))[0].toPandas()
    toxic = got.doc_id % 3 == 0
    assert not got[toxic].kept.any() and got[~toxic & (got.doc_id >= 120)].kept.mean() >= 0.95
    kept = {r.doc_id for r in o5.kept_documents(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert kept == set(got[got.kept].doc_id)


def test_toxic_documents_of_the_tables(spark):
    known = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = o5.op5_importance_resampling(spark, "/root/testdata/sf0.01").toPandas().merge(known, on="doc_id")
    assert got[(got.toxic == 1) & (got.quality == 1)].kept.mean() <= 0.5
    assert got[(got.toxic == 0) & (got.quality == 1)].kept.mean() >= 0.95


def test_buckets_grow():
    assert o5.buckets(0) == o5.buckets(10_000) == o5.BUCKETS and o5.buckets(1_000_000) == 16 * o5.BUCKETS
    assert o5.grams("a b c", 1 << 20).max() >= o5.BUCKETS or np.any(o5.grams("a b c", 1 << 20) != o5.grams("a b c"))
