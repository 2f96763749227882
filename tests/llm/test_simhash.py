import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import op9_simhash as s
from tessera.llm.common import cut
from tests.llm.util import texts, words, write_tables


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, radius=4):
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for d, p in prints:
        low[find(p)] = min(filter(lambda x: x is not None, (low.get(find(p)), d)), default=None)
    return Counter((d, f"{p:016x}", low[find(p)]) for d, p in prints)


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_equals_brute_force(spark, sf, tmp_path, which):
    where = sf if which == "sf" else write_tables(spark, tmp_path)
    docs = texts(where)
    prints = [(None if d != d else int(d), plain_fingerprint(t if isinstance(t, str) else None)) for d, t in zip(docs.doc_id.astype(float), docs.text)]
    assert Counter(tuple(r) for r in s.op9_covering_lsh(spark, where).collect()) == plain_components(prints)


def test_empty_table(spark, tmp_path):
    assert s.op9_covering_lsh(spark, write_tables(spark, tmp_path, [])).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = s.covering_masks(), random.Random(1)
    assert len(masks) == 31 and all((m & (1 << 64) - 1).bit_count() == 32 for m in masks)
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(d & m & (1 << 64) - 1 == 0 for m in masks)


@pytest.mark.parametrize("pairwise", [6000, 40, 2])
def test_all_bucket_sizes_lose_nothing(spark, pairwise):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = cut(spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long"))
    linked = s.stars(s.links(df, 4, pairwise)).collect()
    root = {p: p for p in prints}
    root.update({r.a % 2**64: r.root % 2**64 for r in linked})
    want = plain_components(list(enumerate(prints)))
    got, low = {}, {}
    for i, p in enumerate(prints):
        low[root[p]] = min(low.get(root[p], i), i)
    for i, p in enumerate(prints):
        got[(i, f"{p:016x}", low[root[p]])] = 1
    assert Counter(got) == want
