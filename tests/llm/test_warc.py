import gzip
import io
from collections import Counter

import duckdb
import pytest

from tessera.llm import op2_warc as w
from tessera.llm.common import cut

SCHEMA = "page_id long, url string, html string, refers_to string, _key int"


def pages():
    big = "<p>" + "é" * 900
    rows = [(1, "http://a/1", big), (9, "http://a/ü\r\nx", big), (4, None, big), (None, "u", big), (5, "", None), (6, "http://b", ""), (7, "http://b", "short"), (8, "c", "short")]
    rows += [(20, "d", "z" * 1000), (20, "d", "z" * 1000), (3, "d", "z" * 1000), (21, "WARC", "WARC/1.1\r\n" + "y" * 300_000), (22, "x", "a" * 999), (23, "x", "a" * 999)]
    return [(*r, "clash", 1) for r in rows]


def test_round_trip_equals_sql(spark, sf, tmp_path):
    for where in (sf, str(tmp_path)):
        if where != sf:
            spark.createDataFrame(pages(), SCHEMA).write.parquet(f"{where}/pages.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{where}/pages.parquet{'' if where == sf else '/*.parquet'}')")
        got = Counter(tuple(r) for r in w.op2_warc(spark, where).collect())
        assert got == Counter(db.sql(w.ORACLE).fetchall())


def test_payloads_and_rolling(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    manifest = cut(w.write_archives(w.with_revisits(df).coalesce(1), f"file://{tmp_path}/a", archive_bytes=300))
    assert manifest.count() > 3
    rows = [r for r in w.read_archives(manifest).collect() if r.record_type == "response"]
    assert Counter((r.page_id, bytes(r.payload)) for r in rows) <= Counter((p[0], (p[2] or "").encode()) for p in pages())
    assert {bytes(r.payload) for r in rows} == {(p[2] or "").encode() for p in pages()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert w.op2_warc(spark, str(tmp_path)).count() == 0


def records(n=30):
    return [w.page_record(i, f"http://h/{i}", bytes([65 + i % 26]) * (50 + 40 * i), None) for i in range(n)]


def ids(found):
    return [int(item[3]["warc-record-id"][1:-1].rpartition(":")[2]) for item in found if item[0] == "record"]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "end", "head"])
def test_salvage(zipped, damage):
    parts = [w.member(r) if zipped else r for r in records()]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    data, lost = bytearray(b"".join(parts)), {11}
    if damage == "flip":
        data[starts[12] - (12 if zipped else 40)] ^= 0x55
    elif damage == "cut":
        del data[starts[11] + 40 : starts[12] - 3]
    elif damage == "junk":
        data[starts[11] : starts[11]] = b"\x1f\x8b\x08 no member \r\nWARC/1.9 no version" * 3
        lost = set()
    elif damage == "end":
        del data[starts[29] + 30 :]
        lost = {29}
    else:
        data[0:8] = b"WARC/1.0" if zipped else b"\x00" * 8
        lost = {0}
        if zipped:
            data[0:3] = b"\x1f\x8b\x09"
    found = list(w.salvage(io.BytesIO(bytes(data)), len(data)))
    assert ids(found) == [i for i in range(30) if i not in lost]
    gaps = [x for x in found if x[0] == "gap"]
    assert len(gaps) == 1 and gaps[0][3]
    at = 0
    for _, offset, length, *_ in found:
        assert offset == at
        at += length
    assert at == len(data)


def test_digest_and_length_damage_in_plain_archives():
    parts = records(6)
    bad = parts[2].replace(b"CCCC", b"CCcC", 1)
    found = list(w.salvage(io.BytesIO(b"".join([*parts[:2], bad, *parts[3:]])), sum(map(len, parts))))
    assert ids(found) == [0, 1, 3, 4, 5] and [x[1:3] for x in found if x[0] == "gap"] == [(sum(map(len, parts[:2])), len(bad))]
    long = parts[2].replace(b"\r\nContent-Length: 2", b"\r\nContent-Length: 9", 1)
    found = list(w.salvage(io.BytesIO(b"".join([*parts[:2], long, *parts[3:]])), sum(map(len, parts))))
    assert ids(found) == [0, 1, 3, 4, 5]


def test_members_of_other_writers():
    data = b"".join(gzip.compress(r) for r in records(4))
    assert ids(w.salvage(io.BytesIO(data), len(data))) == [0, 1, 2, 3]
    assert list(w.salvage(io.BytesIO(b""), 0)) == [] and [x[0] for x in w.salvage(io.BytesIO(b"none"), 4)] == ["gap"]
