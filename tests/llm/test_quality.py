import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import op4_lines as o4
from tessera.llm import op5_resample as o5
from tessera.llm.common import cut
from tests.llm.util import odd_documents, texts, words, write_tables


def add_labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def plain_repeats(w):
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def plain_base(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, plain_repeats(w)


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_base_columns_against_brute_force(spark, sf, tmp_path, which):
    where = sf
    if which == "odd":
        where = write_tables(spark, tmp_path)
        add_labels(spark, where, [(0, 1, 0, "x"), (0, 1, 0, "x"), (1, 0, None, None), (None, 1, 0, None), (2, None, 0, None)])
    docs = texts(where)
    got = o4.op4_line_crf(spark, where).toPandas()
    want = Counter()
    for d, t in zip(docs.doc_id.astype(float), docs.text):
        base = plain_base(t if isinstance(t, str) else None)
        want[(None if d != d else int(d), *base, base[0] < 20 or 100 * base[4] > 30 * base[0])] += 1
    key = list(o4.COLUMNS[:7])
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:6]), bool(r[6])) for r in got[key].astype({"doc_id": float}).values.tolist()) == want
    assert not (got.kept & got.base_failed).any()


def test_good_documents_stay_and_bad_ones_go(spark, sf):
    known = pd.read_parquet(f"{sf}/labels.parquet")
    got = o4.op4_line_crf(spark, sf).toPandas().merge(known, on="doc_id")
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.mean() >= 0.97 and got[got.quality == 0].kept.mean() <= 0.1
    again = o4.op4_line_crf(spark, sf).toPandas()
    assert again.sort_values("doc_id").kept.tolist() == o4.op4_line_crf(spark, sf).toPandas().sort_values("doc_id").kept.tolist()


def best_path(emit, pairs):
    """By the best score of every prefix and label, from tuples."""
    best = {0: (0.0, ()), 1: (emit[0], ())}
    for t, e in enumerate(emit):
        if t:
            best = {y: max(((best[z][0] + pairs[z][y] + e * y, (*best[z][1], z)) for z in (0, 1))) for y in (0, 1)}
    end = max((0, 1), key=lambda y: (best[y][0], y))
    return [*best[end][1], end]


def plain_kept(text, model):
    """The verdict from the weights alone: base rules and the share of words in content lines."""
    n, *_, repeats = plain_base(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    features = o4.lines_of(text)[0]
    assert len(lines) == len(features)
    if n < 20 or 100 * repeats > 30 * n:
        return False
    labels = best_path([sum(w for i, w in enumerate(model[0]) if f >> i & 1) for f in features], model[1])
    return 2 * sum(len(words(x)) for x, y in zip(lines, labels) if y) >= n


def test_kept_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = o4.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: (r.kept, r.content_words, r.n_words) for r in o4.op4_line_crf(spark, sf).collect()}
    want = {r.doc_id: plain_kept(r.text, model) for r in docs.collect()}
    assert {d: k for d, (k, _, _) in got.items()} == want
    # labels differ inside documents, and both verdicts occur
    assert sum(0 < c < n for _, c, n in got.values()) >= 0.05 * len(got) and 0 < sum(want.values()) < len(want)


def test_planted_boilerplate_is_told_from_its_neighbours(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = o4.train(docs, labels)
    good = docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").limit(8).collect()
    block = ["Home | Login | Contact | Privacy | Cookie policy", "CLICK HERE!! SUBSCRIBE NOW!! BUY!! BUY!! BUY!!", "Home | Login | Contact | Privacy | Cookie policy", "All rights reserved. http://example.com | Copyright"]
    rows, planted = [], {}
    for d in good:
        lines = [x for x in d.text.split("\n") if len(words(x)) > 7 and not o4.line_features(x, words(x), False) & o4.MARKS]
        if len(lines) >= 2:
            k = len(lines) // 2
            rows.append((d.doc_id, "\n".join([*lines[:k], *block, "", *lines[k:]])))
            planted[d.doc_id] = set(range(k, k + len(block)))
    got = o4.labelled_lines(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(planted) >= 4 and all(r.content == (r.line not in planted[r.doc_id]) for r in got)
    assert len(got) == sum(sum(bool(words(x)) for x in t.split("\n")) for _, t in rows)


def test_share_of_sampled_documents_follows_their_label():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        emit, sizes, pairs = rng.normal(0, 3, n).tolist(), rng.integers(1, 20, n).tolist(), rng.normal(size=(2, 2)).tolist()
        for good in (True, False):
            labels = o4.within_share(emit, pairs, sizes, good)
            assert (2 * sum(s for s, y in zip(sizes, labels) if y) >= sum(sizes)) == good
    assert o4.fit_latent([([1], [5], True)]) == ([0.0] * o4.N_FEATURES, [[0.0, 0.0], [0.0, 0.0]])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, emit, pairs = int(rng.integers(1, 7)), None, rng.normal(size=(2, 2))
        emit = rng.normal(size=n)
        score = lambda y: sum(e for e, v in zip(emit, y) if v) + sum(pairs[a][b] for a, b in zip(y, y[1:]))
        assert score(o4.viterbi(emit.tolist(), pairs.tolist())) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=n))))
    assert o4.viterbi([], [[0, 0], [0, 0]]) == []


def test_likelihood_and_gradient_by_enumeration():
    rng = np.random.default_rng(2)
    w, pairs, masks = rng.normal(size=o4.N_FEATURES), rng.normal(size=(2, 2)), np.array([[3, 5, 9, 0], [7, 1, 0, 0]])
    y, length = np.array([[1, 1, 0, 0], [0, 1, 0, 0]]), np.array([4, 2])
    x = o4._dense(masks)

    def value(w, pairs):
        total = 0.0
        for row, labels, n in zip(x, y, length):
            score = lambda z: sum(row[t] @ w for t in range(n) if z[t]) + sum(pairs[a][b] for a, b in zip(z[:n], z[1:n]))  # noqa: E731, B023
            total += score(labels) - math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=n)))
        return total

    got, by_w, by_pairs = o4.log_likelihood(w, pairs, x, y, length)
    assert got == pytest.approx(value(w, pairs))
    for k in range(4):
        step = np.zeros(o4.N_FEATURES)
        step[k] = 1e-5
        assert by_w[k] == pytest.approx((value(w + step, pairs) - value(w - step, pairs)) / 2e-5, abs=1e-5)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert by_pairs[a, b] == pytest.approx((value(w, pairs + step) - value(w, pairs - step)) / 2e-5, abs=1e-5)


def test_resampling_keeps_good_documents(spark, sf):
    known = pd.read_parquet(f"{sf}/labels.parquet")
    got = o5.op5_importance_resampling(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(pd.read_parquet(f"{sf}/documents.parquet").doc_id)
    merged = got.merge(known, on="doc_id")
    assert merged[(merged.quality == 1) & (merged.toxic == 0)].kept.mean() >= 0.97 and merged[merged.quality == 0].kept.mean() <= 0.35
    # the kept are the documents of largest key
    assert got[got.kept].key.min() >= got[~got.kept].key.max()


def test_resampling_counts_against_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    raw, target = o5.counts(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([(int(docs.doc_id[0]), 1, 0, 0), (int(docs.doc_id[1]), 1, 0, 1)], "label_id long, quality int, toxic int, fold int"))
    want = sum(np.bincount(o5.grams(t), minlength=o5.BUCKETS) for t in docs.text)
    assert (raw == want).all() and (target == np.bincount(o5.grams(docs.text[0]), minlength=o5.BUCKETS)).all()
    assert sum(raw) == sum(max(0, 2 * len(words(t)) - 1) for t in docs.text)


def test_draws_follow_the_weights(spark):
    """Over many seeds the share of samples that hold an item is that of drawing without replacement by weight."""
    weights, k = [1.0, 2.0, 4.0, 8.0, 1.0], 2
    want = [0.0] * len(weights)
    for order in itertools.permutations(range(len(weights)), k):
        p, left = 1.0, sum(weights)
        for i in order:
            p, left = p * weights[i] / left, left - weights[i]
        for i in order:
            want[i] += p
    rows = spark.range(4000).selectExpr("id as turn").crossJoin(spark.createDataFrame([(i, math.log(w)) for i, w in enumerate(weights)], "item int, log_weight double"))
    keys = rows.withColumn("key", F.col("log_weight") + o5.gumbel(F.expr("turn * 10 + item"))).toPandas()
    taken = keys.sort_values("key").groupby("turn").tail(k).item.value_counts().sort_index() / 4000
    assert np.abs(taken.values - want).max() < 0.03


def test_sample_size_and_seed_are_parameters(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    samples = []
    for seed in ("a", "b"):
        got = o5.resample(docs, labels, k=100, seed=seed)[0].toPandas()
        assert got.kept.sum() == 100 and got[got.kept].key.min() >= got[~got.kept].key.max()
        samples.append(set(got[got.kept].doc_id))
    assert samples[0] != samples[1]
    assert not o5.resample(docs, labels, k=0)[0].where("kept").count() and o5.kept_documents(docs, labels, k=7).count() == 7


def test_weights_against_brute_force(spark, sf):
    """Log weights from own counts of the same buckets, and the verdict from sorting all keys."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chosen = {r.label_id: r for r in o5.sample(labels).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(o5.grams(t).tolist())
        if d in chosen and chosen[d].quality and not chosen[d].toxic and not chosen[d].fold:
            target.update(o5.grams(t).tolist())
    size, n_raw, n_target = o5.BUCKETS, sum(raw.values()), sum(target.values())
    log = lambda c, n: math.log((c + 1) / (n + size))
    got = {r.doc_id: r for r in o5.resample(docs, labels)[0].collect()}
    for d, t in rows:
        found = o5.grams(t).tolist()
        want = 100 * sum(log(target[g], n_target) - log(raw[g], n_raw) for g in found) / (len(found) + 30)
        assert got[d].log_weight == -math.inf or got[d].log_weight == pytest.approx(want, abs=1e-6)
    good = [got[d].log_weight for d, r in chosen.items() if d in got and r.quality and not r.toxic and r.fold and got[d].log_weight > -math.inf]
    k = sum(r.log_weight >= np.quantile(good, 0.005) for r in got.values() if r.log_weight > -math.inf)
    cut_at = sorted((r.key for r in got.values() if r.key > -math.inf), reverse=True)[k - 1]
    assert {d for d, r in got.items() if r.kept} == {d for d, r in got.items() if r.key >= cut_at}


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500), [1e6, -1e6], np.full(60, 0.25)])
    keys = cut(spark.createDataFrame([(float(v),) for v in values], "key double"))
    for k in (1, 2, 100, 250, 300, len(values)):
        assert o5.kth_largest(keys, k, at_once=20) == np.sort(values)[-k]


def test_odd_rows_and_missing_labels(spark, tmp_path):
    where = write_tables(spark, tmp_path)
    add_labels(spark, where, [])
    got = o5.op5_importance_resampling(spark, where).toPandas()
    assert len(got) == len(odd_documents()) and got.kept.all()
    assert o4.op4_line_crf(spark, where).toPandas().kept.any()
    empty = write_tables(spark, tmp_path / "none", [])
    add_labels(spark, empty, [(1, 1, 0, "x")])
    assert o5.op5_importance_resampling(spark, empty).count() == 0 and o4.op4_line_crf(spark, empty).count() == 0
