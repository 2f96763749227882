import hashlib
import random
from collections import Counter

import duckdb
import pytest

from tessera.llm import op6_passages as p
from tests.llm.util import SCHEMA, frame, texts, words, write_tables


def brute(docs):
    first, out = {}, Counter()
    rank = lambda d: p.LAST_ID if d is None else d
    parsed = [(d, words(t)) for d, t in docs]
    for d, w in parsed:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, rank(d)), rank(d))
    for d, w in parsed:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < rank(d):
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[(d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("which", ["sf", "odd", "hard"])
def test_equals_brute_force(spark, sf, tmp_path, which):
    where = sf
    if which == "odd":
        where = write_tables(spark, tmp_path)
    elif which == "hard":
        rng = random.Random(4)
        pool = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(40, 400))] for _ in range(12)]
        rows = []
        for i in rng.sample(range(1000), 90):
            w = []
            for _ in range(rng.randint(1, 4)):
                source = rng.choice(pool)
                a = rng.randint(0, max(0, len(source) - 45))
                w += source[a : a + rng.randint(30, 300)]
                w += [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 3))]
            rows.append((i, " ".join(w)))
        rows += [(2000, " ".join(["be"] * 300)), (2001, " ".join(["be"] * 120)), (2002, "ab " + " ".join(["be"] * 49)), (2003, " ".join(["be", "to"] * 90))]
        rows += [(None, rows[0][1]), (rows[5][0], rows[7][1]), (3000, rows[3][1] + " tail")]
        where = write_tables(spark, tmp_path, [(d, t, None, None, None, 1, 1.0, "", 1) for d, t in rows])
    docs = texts(where)
    pairs = [(None if d != d else int(d), t if isinstance(t, str) else None) for d, t in zip(docs.doc_id.astype(float), docs.text)]
    want = brute(pairs)
    assert sum(r[2] * n for r, n in want.items())
    assert got(p.op6_phrase_automata(spark, where)) == want


def test_empty_and_carried_columns(spark, tmp_path):
    assert p.op6_phrase_automata(spark, write_tables(spark, tmp_path, [])).count() == 0
    docs = frame(spark)
    out = p.deduplicated(docs, True, docs.columns)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert (r._kept_text == r.text) if not r._n_removed else len(words(r._kept_text)) == r._n_words - r._n_removed
    assert p.deduplicated(spark.createDataFrame([], SCHEMA), True).count() == 0


def test_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert Counter(db.sql(p.ORACLE).fetchall()) == got(p.op6_phrase_automata(spark, sf))


def test_many_documents_of_one_id_or_none(spark, tmp_path):
    """A row's list of representatives holds its own alone, however many rows share its id."""
    rng = random.Random(9)
    make = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(n)]
    passage = make(80)
    rows = [(d, " ".join([*make(60), *passage, *make(10)]), None, None, None, 1, 1.0, "", 1) for d in [5, *[None] * 40, *[9] * 40]]
    where = write_tables(spark, tmp_path, rows)
    assert got(p.op6_phrase_automata(spark, where)) == brute([r[:2] for r in rows])
