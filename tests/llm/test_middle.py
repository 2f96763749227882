import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import op13_middle as m
from tessera.llm import rope
from tests.llm.util import frame, odd_documents, write_tables

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    digest = SHA(f"1:{'' if doc_id is None else doc_id}")
    h, n = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)], len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, SHA(text), SHA(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, a, b - a, SHA(out), SHA(text)


def odd_rows():
    more = [(800 + i, t) for i, t in enumerate(["x", "<P>", "a <M> b", "<" * 50, "<P" * 40, "S>" * 40, "é\U0001f600" * 700, "\r\n\t\x00" * 300, "<" * 2000 + "P>" * 3])]
    return odd_documents() + [(d, t, "en", "a", None, 7, 0.5, "x", 3) for d, t in more] + [(900 + i, "<S<M<P" * i, "en", "a", None, 7, 0.5, "x", 3) for i in range(1, 60)]


def test_equals_brute_force_and_sql_on_odd_rows(spark, tmp_path):
    where = write_tables(spark, tmp_path, odd_rows())
    want = Counter(plain(r[0], r[1]) for r in odd_rows())
    assert Counter(map(tuple, m.op13_middle_ropes(spark, where).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    assert Counter(db.sql(m.ORACLE).fetchall()) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_equals_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = Counter(plain(int(d), t if isinstance(t, str) else None) for d, t in zip(docs.doc_id, docs.text))
    assert Counter(map(tuple, m.op13_middle_ropes(spark, sf).collect())) == want


def test_no_exchange_and_empty_table(spark, tmp_path, sf):
    assert "Exchange" not in m.op13_middle_ropes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert m.op13_middle_ropes(spark, write_tables(spark, tmp_path, [])).count() == 0


def test_other_units_and_seeds_come_back(spark):
    docs = frame(spark)
    for unit in (r"\s+|\S+", r"(?s).{1,3}"):
        got = m.restored(m.transformed(docs, unit, seed=5)).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t or "") for d, t, *_ in odd_documents())
        assert all(r.n == len(re.findall(unit, r.text)) for r in got)


TEXTS = st.text(alphabet=st.sampled_from("ab<>PSM é\U0001f600\n"), max_size=200)


def check(tree):
    """Cached counts are right and heights differ by one at most; returns units, points, height."""
    if tree is None or isinstance(tree, rope.Leaf):
        return (0, 0, 0) if tree is None else (tree.units, len(tree.text), 0)
    one, other = check(tree.left), check(tree.right)
    found = (one[0] + other[0], one[1] + other[1], 1 + max(one[2], other[2]))
    assert (tree.units, tree.points, tree.height) == found and abs(one[2] - other[2]) <= 1
    return found


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9), st.randoms(use_true_random=False))
def test_ropes_cut_and_join_like_strings(text, leaf_units, rng):
    tree = rope.build(text, None, leaf_units)
    for _ in range(12):
        k = rng.randint(-1, len(text) + 1)
        one, other = rope.split(tree, k)
        cut = max(0, k)
        assert "".join(rope.pieces(one)) == text[:cut] and "".join(rope.pieces(other)) == text[cut:]
        tree, text = rope.join(other, one), text[cut:] + text[:cut]
        assert check(tree)[:2] == (len(text), len(text))


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_round_trip(text, chosen):
    n, form, _, _, out = m.transform(text, chosen)
    assert n == len(text) and m.restore("".join(rope.pieces(out)), form) == text


def test_units_of_words_keep_their_counts():
    rng = random.Random(3)
    text = " ".join("w" * rng.randint(1, 9) for _ in range(500))
    pattern = re.compile(r"\s+|\S+")
    found = pattern.findall(text)
    tree = rope.build(text, pattern, 16)
    for k in (0, 1, 15, 16, 17, 498, len(found)):
        one, other = rope.split(tree, k, unit=pattern)
        assert "".join(rope.pieces(one)) == "".join(found[:k]) and (one.units if one else 0) == k
        assert (other.units if other else 0) == len(found) - k
    with pytest.raises(ValueError):
        rope.build("a b", re.compile("a"))
