from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline as c
from tests.llm.util import frame, words


def plain_kept(rows):
    """doc_ids that stay: one of each component of pairs with Jaccard 0.8 or more of 5-word shingles."""
    sets = []
    for _, text in rows:
        w = words("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [()]:
            holders[x].append(i)
    for i, j in {p for h in holders.values() for p in combinations(h, 2)}:
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(filter(lambda x: x is not None, (low.get(find(i)), d)), default=None)
    return Counter({d for i, (d, _) in enumerate(rows) if d is not None and d == low[find(i)]}) + Counter(d for d, _ in rows if d is None)


@pytest.mark.parametrize("which", ["sf0.001", "sf0.01", "odd"])
def test_near_dedup_stage_against_brute_force(spark, which):
    docs = frame(spark) if which == "odd" else spark.read.parquet(f"/root/testdata/{which}/documents.parquet")
    got = Counter(r.doc_id for r in c.near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_copies_with_a_few_changed_words_go_and_other_texts_stay(spark):
    base = [f"w{i}" for i in range(400)]
    near, far = list(base), list(base)
    for i in range(20, 400, 60):
        near[i] = "new"  # 7 words, 35 of 396 shingles: similarity 0.84
    for i in range(20, 400, 20):
        far[i] = "other"
    rows = [(k, " ".join(w), "en", "a", None, 7, 0.5, "x", 3) for k, w in enumerate((base, near, far))]
    assert sorted(r.doc_id for r in c.near_dedup(spark, frame(spark, rows), "").collect()) == [0, 2]
