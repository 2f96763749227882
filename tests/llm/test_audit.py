import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from tessera.llm import op12_audit as a
from tests.llm.util import frame, odd_documents, words, write_tables

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """The contract by running every order over every document."""
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = defaultdict(list)
    for d, text, source in rows:
        t = text or ""
        w = words(t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        failed["E"] = d is not None and d > first[t]
        good, toxic = (any(x[i] == 1 for x in labels.get(d, [])) if d is not None else False for i in (0, 1))
        parts[source or ""].append((failed, good, toxic))
    out, shapley = [], Counter()
    for part, found in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                failing = sum(x[0][f] for x in found)
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), failing - len(gone), sum(x[0][f] and sum(x[0].values()) == 1 for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)])
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def odd_rows():
    rows = odd_documents()
    rows += [(700 + i, t, "x", s, None, 7, 0.5, "x", 3) for i, (t, s) in enumerate([("A" * 30 + " b" * 60, "a"), ("# " * 80, None), ("Ab " * 70, "c"), ("ÄÖÜ ä " * 40, ""), ("| a b", "b"), ("w " * 60, "d")])]
    return rows


LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 1), (3, 1, 0), (101, 1, 1), (103, 0, 0), (122, 1, None), (123, None, 1), (None, 1, 1), (704, 1, 1), (999, 1, 1)]


def test_equals_brute_force_on_odd_rows(spark, tmp_path):
    where = write_tables(spark, tmp_path, odd_rows())
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    by_id = defaultdict(list)
    for d, quality, toxic in LABELS:
        by_id[d].append((quality, toxic))
    want = plain([(r[0], r[1], r[3]) for r in odd_rows()], by_id)
    assert Counter(tuple(r) for r in a.op12_filter_replay(spark, where).select(*NAMES).collect()) == want
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}/{name}.parquet/*.parquet'")
    assert Counter(db.sql(a.ORACLE).select(*NAMES).fetchall()) == want


@pytest.mark.parametrize("which", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, which):
    where = f"/root/testdata/{which}"
    docs, labels, by_id = pd.read_parquet(f"{where}/documents.parquet"), pd.read_parquet(f"{where}/labels.parquet"), defaultdict(list)
    for d, quality, toxic in zip(labels.doc_id, labels.quality, labels.toxic):
        by_id[d].append((quality, toxic))
    text = lambda x: x if isinstance(x, str) else None
    want = plain([(int(d), text(t), text(s)) for d, t, s in zip(docs.doc_id, docs.text, docs.source)], by_id)
    got = a.op12_filter_replay(spark, where).select(*NAMES).collect()
    assert Counter(tuple(r) for r in got) == want
    assert len(got) == 600 * len({r[0] for r in want})


def test_weights_stand_for_repeated_flags(spark):
    flagged = a.flags(frame(spark, odd_rows()), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    combined = flagged.groupBy(*flagged.columns).agg(a.F.count("*").alias("weight"))
    assert Counter(map(tuple, a.replay(flagged).collect())) == Counter(map(tuple, a.replay(combined).collect()))


def test_sums_are_combined_before_the_exchange(spark, sf):
    plan = a.op12_filter_replay(spark, sf)._jdf.queryExecution().executedPlan().toString()
    crossed = plan.index("BroadcastNestedLoopJoin")
    assert plan.rindex("partial_sum", 0, crossed) < crossed and "CartesianProduct" not in plan


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert a.replay(a.flags(docs, labels)).count() == 0
    assert a.replay(a.flags(frame(spark), labels)).where("good_lost > 0 OR toxic_lost > 0").count() == 0
