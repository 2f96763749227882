import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import op11_minhash as m
from tests.llm.util import SCHEMA, frame, texts, words, write_tables


def plain(rows):
    """What the contract says, by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, j in {p for h in holders.values() for p in combinations(sorted(h), 2)}:
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(filter(lambda x: x is not None, (low.get(find(i)), d)), default=None)
    return Counter((d, len(s), low[find(i)], d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("which", ["sf0.001", "sf0.01", "odd"])
def test_equals_brute_force(spark, tmp_path, which):
    where = write_tables(spark, tmp_path) if which == "odd" else f"/root/testdata/{which}"
    docs = texts(where)
    rows = [(None if d != d else int(d), t if isinstance(t, str) else None) for d, t in zip(docs.doc_id.astype(float), docs.text)]
    assert Counter(tuple(r) for r in m.op11_bbit_minhash(spark, where).collect()) == plain(rows)


def test_chains_in_crowded_buckets_are_linked(spark):
    """Texts that share most of a passage meet in many buckets, and links there lead from neighbour to neighbour."""
    rng, rows = random.Random(5), []
    shared = [f"s{i}" for i in range(300)]
    for group in range(6):
        text = shared + [f"g{group}-{i}" for i in range(rng.randint(20, 300))]
        for step in range(30):
            text = list(text)
            for _ in range(rng.choice([2, 4, 9])):
                text[rng.randrange(len(text))] = f"n{rng.random()}"
            rows.append((1000 - len(rows), " ".join(text), "en", "a", None, 7, 0.5, "x", 3))
    got = Counter(tuple(r) for r in m.components(frame(spark, rows)).collect())
    assert got == plain([r[:2] for r in rows])


def test_empty_table(spark):
    assert m.components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.7, 0.85, 0.95])
def test_estimates_are_unbiased_and_rarely_under_the_cut(spark, share):
    rng, pairs = np.random.default_rng(1), []
    for _ in range(300):
        both = rng.integers(0, 2**64, round(400 * share), np.uint64)
        rest = rng.integers(0, 2**64, 400 - len(both), np.uint64)
        x, y = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
        pairs.append(tuple(m.signatures(m.minima(z)[None])[0].tolist() for z in (x, y)))
    got = [r[0] for r in spark.createDataFrame(pairs, "x array<long>, y array<long>").select(m.estimate(m.F.col("x"), m.F.col("y"))).collect()]
    assert abs(np.mean(got) - share) < 0.01
    if share >= 0.85:
        assert min(got) > m.least_estimate(m.SIMILARITY)


def test_pairs_at_the_threshold_meet_in_a_band():
    rng, met = np.random.default_rng(2), 0
    for _ in range(400):
        both, rest = rng.integers(0, 2**64, 340, np.uint64), rng.integers(0, 2**64, 60, np.uint64)
        x, y = (m.band_keys(m.minima(np.concatenate([both, r]))[None])[0] for r in (rest[::2], rest[1::2]))
        met += bool((x == y).any())
    assert met == 400
