import functools
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import common, op1_mix, op3_shard, op7_token_files, op8_pack, simple8b, tokens
from tests.llm.util import SCHEMA, frame, odd_documents, texts, words, write_tables


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_mix_equals_sql(spark, sf, tmp_path, which):
    where = sf if which == "sf" else write_tables(spark, tmp_path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet{'' if which == 'sf' else '/*.parquet'}'")
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    row = lambda r: tuple(round(float(x), 6) if n == "target" else x for n, x in zip(names, r))
    want = Counter(map(row, db.sql(op1_mix.ORACLE).select(*names).fetchall()))
    assert Counter(row(tuple(r)) for r in op1_mix.op1_pareto_mix(spark, where).select(*names).collect()) == want


def test_mix_rows_without_ids_and_equal_rows_meet_the_targets(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(["w"] * int(rng.integers(50, 400)) + [str(rng.integers(10**9))])
    rows = [(None, text(), "a") for _ in range(400)] + [(7, "x " * 200, "b")] * 400 + [(i, text(), "c") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op1_mix.mix(docs).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 400
    assert got[got.source == "b"].copies.nunique() > 1
    taken = op1_mix.mixed_documents(docs).groupBy("source").count().collect()
    assert {r[0]: r[1] for r in taken} == got.groupby("source").copies.sum().to_dict()


def test_mix_meets_targets_and_repeats(spark, sf):
    got = op1_mix.op1_pareto_mix(spark, sf).toPandas()
    again = op1_mix.op1_pareto_mix(spark, sf).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    assert (got.taken <= 3 * got["size"]).all()
    for _, rows in got.groupby("source", dropna=False):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= rows["size"].max() / 2 + 1
    assert abs(got.groupby("source", dropna=False).target.first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()


def test_mix_odd_rows(spark):
    docs = frame(spark)
    got = op1_mix.mix(docs).toPandas()
    assert len(got) == docs.count() and got["size"].sum() == sum(len(words(r[1])) for r in odd_documents())
    assert set(got.source.dropna()) == {"a", "b", "c", ""} and got.source.isna().any()
    assert (got.taken == got["copies"] * got["size"]).all() and got["copies"].between(0, 3).all()
    copies = op1_mix.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == got["copies"].sum()
    empty = spark.createDataFrame([], SCHEMA)
    assert op1_mix.mix(empty).count() == 0 and op1_mix.mixed_documents(empty).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in op1_mix.source_targets(sizes).collect()}
    # a wants 5/13 of 1510 and stops at 30, c at 0; b (2) and null (5) share the rest by weight
    assert got["a"] == 30 and got["c"] == 0
    assert got["b"] == pytest.approx(1480 * 2 / 7) and got[None] == pytest.approx(1480 * 5 / 7)


def test_differencing_beats_greedy_and_keeps_items():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 5000, 400).tolist()
    found = op3_shard.differencing(sizes, 16)
    sums = [sum(s for s, k in zip(sizes, found) if k == shard) for shard in range(16)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 50
    assert op3_shard.differencing([], 16) == [] and op3_shard.differencing([5], 16)[0] in range(16)
    two = op3_shard.differencing([8, 7, 6, 5, 4], 2)
    assert {sum(s for s, k in zip([8, 7, 6, 5, 4], two) if k == shard) for shard in (0, 1)} == {14, 16}


def plain_differencing(sizes, shards):
    """The textbook rule on lists of member sets, the whole list sorted at every step."""
    parts = [([s, *[0] * (shards - 1)], [{i}, *[set() for _ in range(shards - 1)]]) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[0][-1])
        (a, in_a), (b, in_b) = parts.pop(), parts.pop()
        both = sorted(((x + y, p | q) for x, y, p, q in zip(a, b[::-1], in_a, in_b[::-1])), key=lambda t: -t[0])
        parts.append(([t[0] for t in both], [t[1] for t in both]))
    return parts[0]


def test_differencing_against_the_textbook():
    rng = np.random.default_rng(8)
    for shards in (2, 3, 16):
        for _ in range(20):
            sizes = [int(x) for x in rng.choice(10**9, int(rng.integers(1, 60)), replace=False)]
            found = op3_shard.differencing(sizes, shards)
            assert sorted((sum(s for s, k in zip(sizes, found) if k == shard) for shard in range(shards)), reverse=True) == plain_differencing(sizes, shards)[0]


def test_every_group_is_differenced(spark):
    """In one part the shards of the query are those of the rule on all groups, at any number of groups."""
    rows = [(i, "x" * (i * 37 % 1009 + i % 5)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = Counter()
    for _, t in rows:
        sums[t] += len(t) + 1
    got = op3_shard.assign(docs).groupBy("shard").sum("size").collect()
    assert sorted((r[1] for r in got), reverse=True) == plain_differencing(list(sums.values()), 16)[0]
    # in many parts nothing is bundled either: the parts' partitions are combined by the same rule
    parts = op3_shard.assign(docs, part_groups=100).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in parts]
    assert sum(loads) == sum(sums.values()) and max(loads) - min(loads) <= 100


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_shards(spark, sf, tmp_path, which):
    where = sf if which == "sf" else write_tables(spark, tmp_path)
    docs = texts(where)
    got = op3_shard.op3_karmarkar_karp(spark, where).toPandas()
    raw = [(t or "").encode() for t in docs.text.where(docs.text.notna(), None)]
    want = Counter((None if d != d else int(d), len(b) + 1, zlib.crc32(b)) for d, b in zip(docs.doc_id.astype(float), raw))
    assert Counter((None if d != d else int(d), s, c) for d, s, c in zip(got.doc_id.astype(float), got["size"], got.text_crc32)) == want
    for shard, rows in got.groupby("shard"):
        assert 0 <= shard < 16 and sorted(rows.slot) == list(range(len(rows)))
    assert (got.groupby(["text_crc32", "size"]).shard.nunique() == 1).sum() >= got.groupby(["text_crc32", "size"]).ngroups - 1  # null and empty agree here
    if which == "sf":
        sums = got.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
        assert sums.max() - sums.min() <= 0.02 * sums.mean() or sums.max() <= got.groupby("text_crc32")["size"].sum().max()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_empty_tables(spark, tmp_path):
    where = write_tables(spark, tmp_path, [])
    for query in (op3_shard.op3_karmarkar_karp, op7_token_files.op7_simple8b, op8_pack.op8_minimum_bin_slack):
        assert query(spark, where).count() == 0


def test_pieces_encode_as_whole_texts():
    encoder = tokens.encoder()
    odd = ["a  b", "x\n\n  y z \t", "  lead", " ", "\n", "it's  we'll\r\n ok", "<|endoftext|> a", "x<|endoftext|>", "two words<|endoftext|>\n<|endoftext|> more", "<|endoftext", "", None, "日本 語　x", "a \u0085b", "a\x1c b", "tail   ", "\x0b\x0c v", "abcΩd x'tis foo.bar2 été,naïve×y o'clock ab\u0301c don't"]
    for text, raw in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(raw, "<u4").tolist() == library().encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("top", [0, 1, 2, 255, 50_256, 2**40, 2**60 - 1, 2**60, 2**64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 2, 59, 60, 61, 500):
        values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        values[rng.random(n) < 0.3] %= np.uint64(7)
        assert (simple8b.decode_block(simple8b.encode_block(values)) == values).all()


@functools.cache
def library():
    """The tokenizer as the library reads it."""
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def whole_ids(text, end):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_token_files(spark, sf, tmp_path, which):
    where = sf if which == "sf" else write_tables(spark, tmp_path)
    docs = texts(where)
    got = op7_token_files.op7_simple8b(spark, where).toPandas().sort_values("start").reset_index(drop=True)
    ids = [whole_ids(t if isinstance(t, str) else None, 2) for t in docs.text]
    want = Counter((None if d != d else int(d), len(x), zlib.crc32(x.tobytes())) for d, x in zip(docs.doc_id.astype(float), ids))
    assert Counter((None if d != d else int(d), n, c) for d, n, c in zip(got.doc_id.astype(float), got.n_tokens, got.ids_crc32)) == want
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id.isna().sum() == got.doc_id.head(got.doc_id.isna().sum()).isna().sum()


def test_fullest_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted(set(rng.integers(1, 60, 6).tolist()), reverse=True)
        available, room = [(x, int(rng.integers(1, 4))) for x in lengths], int(rng.integers(1, 150))
        sums = {0}
        for x, n in available:
            sums = {s + x * k for s in sums for k in range(n + 1)}
        chosen = op8_pack.fullest(available, room)
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= dict(available)[x] for x, n in chosen.items())


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_packing(spark, sf, tmp_path, which):
    where = sf if which == "sf" else write_tables(spark, tmp_path)
    docs = texts(where)
    got = op8_pack.op8_minimum_bin_slack(spark, where).toPandas()
    want = Counter()
    for d, t in zip(docs.doc_id.astype(float), docs.text):
        x = whole_ids(t if isinstance(t, str) else None, 0)
        first = len(x) if len(x) <= 2048 else len(x) % 2048 or 2048
        for i, a in enumerate([0, *range(first, len(x), 2048)]):
            part = x[a : first if not i else a + 2048]
            want[(None if d != d else int(d), i, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": float}).values.tolist()) == want
    bins = defaultdict(list)
    for s, o, n in zip(got.sequence_id, got.offset, got.length):
        bins[s].append((o, n))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-int(got.length.sum()) // 2048) * 1.02 + 2


def test_numbering_is_gapless(spark):
    df = common.cut(spark.range(5000).selectExpr("if(id % 3 = 0, 1, id % 7) as g", "id % 50 as k"))
    got = common.numbered(df, "g", ["k"], "n").toPandas()
    for _, rows in got.groupby("g"):
        assert sorted(rows.n) == list(range(len(rows)))


def test_a_worker_holds_one_kind_of_cache():
    from tessera.llm import wordhash

    encoder = tokens.encoder()
    first = encoder.encode(["some words, and more"])
    assert encoder.known
    hashed = wordhash.hashes(["some", "words"])
    assert not encoder.known and wordhash._known
    assert encoder.encode(["some words, and more"]) == first and not wordhash._known
    assert wordhash.hashes(["some", "words"]) == hashed and len(hashed) == 16
