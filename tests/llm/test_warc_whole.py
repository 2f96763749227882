import io
import random

import pytest

from tessera.llm import op2_warc as w
from tessera.llm.common import cut
from tests.llm.test_warc import SCHEMA, ids, records


def test_headers_of_any_length(spark, tmp_path):
    urls = ["http://a/" + "x" * 70_000, "http://b/" + "ü" * 300_000, "c"]
    rows = [(i, u, "html", "clash", 1) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in w.op2_warc(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_a_record_that_is_not_read_back_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "html", "clash", 1) for i in range(5)], SCHEMA)
    manifest = cut(w.write_archives(w.with_revisits(df), f"file://{tmp_path}/a"))
    read = w.read_archives(manifest, with_payload=False)
    assert w.all_pages(manifest, read).count() == 5
    with pytest.raises(ValueError, match="5 records were written, 4 read"):
        w.all_pages(manifest, read.where("page_id IS DISTINCT FROM 3"))


@pytest.mark.parametrize("damage", ["record", "cut", "flip", "crc"])
def test_members_of_several_records(damage):
    rng = random.Random(1)
    parts = [w.page_record(i, f"http://h/{i}", rng.randbytes(30_000), None) for i in range(30)]
    if damage == "record":
        parts[11] = parts[11][:5000] + b"?" + parts[11][5001:]
        parts[12] = b"junk" + parts[12]
    data = bytearray(w.member(b"".join(parts)))
    if damage == "cut":
        del data[len(data) // 2 :]
    elif damage == "flip":
        data[len(data) // 2 : len(data) // 2 + 400] = bytes(400)
    elif damage == "crc":
        data[-6] ^= 0x55
    more = w.member(b"".join(records(3)))
    found = list(w.salvage(io.BytesIO(bytes(data + more)), len(data) + len(more)))
    assert ids(found)[-3:] == [0, 1, 2] and [x for x in found if x[0] == "gap" and x[3]]
    got = ids(found)[:-3]
    if damage == "record":
        assert got == [i for i in range(30) if i != 11]
    elif damage == "crc":
        assert got == list(range(30))
    else:
        assert got[:14] == list(range(14)) and set(got) <= set(range(30)) - {15}


def tiles(found, size):
    """Places of records and gaps cover the file once, and inside a member what it inflates to once."""
    at, inner = 0, None
    for i, (_, offset, length, _, _, begin, n) in enumerate(found):
        if i and offset == found[i - 1][1] and begin is not None:
            assert length == found[i - 1][2] and begin == inner
        else:
            assert offset == at and begin in (0, None)
            at += length
        inner = None if begin is None else begin + n
    assert at == size


TEN = [w.page_record(i, f"http://h/{i}", random.Random(i).randbytes(40_000), None) for i in range(10)]


@pytest.mark.parametrize("limit", [16 << 20, 1000])
@pytest.mark.parametrize("damage", ["none", "record", "two", "cut", "flip", "crc"])
def test_gaps_inside_a_member_are_exact(monkeypatch, damage, limit):
    monkeypatch.setattr(w, "_PEEK_BYTES", limit)
    parts = list(TEN)
    if damage in ("record", "two"):
        parts[4] = parts[4][:900] + bytes([parts[4][900] ^ 1]) + parts[4][901:]
    if damage == "two":
        parts[5] = b"X" + parts[5][1:]
    data = bytearray(w.member(b"".join(parts)))
    if damage == "cut":
        del data[len(data) // 2 :]
    elif damage == "flip":
        data[len(data) // 2 : len(data) // 2 + 90] = bytes(90)
    elif damage == "crc":
        data[-6] ^= 0x55
    more = w.member(TEN[0])
    found = list(w.salvage(io.BytesIO(bytes(data + more)), len(data) + len(more)))
    tiles(found, len(data) + len(more))
    got, gaps = ids(found)[:-1], [x for x in found if x[0] == "gap"]
    starts = [sum(map(len, parts[:i])) for i in range(11)]
    if damage in ("none", "record", "two"):
        lost = {"none": [], "record": [4], "two": [4, 5]}[damage]
        assert got == [i for i in range(10) if i not in lost]
        assert [(g[5], g[6]) for g in gaps] == ([(starts[4], sum(len(parts[i]) for i in lost))] if lost else [])
    else:
        # all whole records come back (random pages are stored, so those after the damage too); the bytes after them are a gap
        assert got == {"crc": list(range(10)), "cut": [0, 1, 2, 3], "flip": [0, 1, 2, 3, 6, 7, 8, 9]}.get(damage) or damage == "flip" and got == [i for i in range(10) if i != 5]
        assert gaps[-1][5] is None and gaps[-1][1] + gaps[-1][2] == len(data) and (damage == "cut" or gaps[-1][2] < 12)
        assert len(gaps) == 1 + (damage == "flip")


def test_members_are_inflated_as_a_stream():
    """Of a member of many records no more is held than a record and a window."""
    most = 0

    class Watched(w.Inflated):
        def forget(self, before):
            nonlocal most
            most = max(most, len(self.held))
            super().forget(before)

    data = w.member(b"".join(w.page_record(i, "u", bytes(100_000), None) for i in range(300)))
    found = list(w._pieces(Watched(io.BytesIO(data), 0)))
    assert len(found) == 300 and most < 3 << 20


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("place", ["own line", "mid-line", "after a blank line", "at the end"])
@pytest.mark.parametrize("damage", ["version", "header", "block"])
def test_records_inside_pages_are_not_records(zipped, place, damage):
    inner = w.page_record(777, "http://phantom", b"<p>nobody wrote this</p>", None)
    html = {"own line": b"<pre>\r\n" + inner + b"</pre>", "mid-line": b"<pre>" + inner + b"</pre>", "after a blank line": b"<pre>\r\n\r\n" + inner + b"</pre>", "at the end": b"<pre>\r\n\r\n" + inner}[place]
    parts = [w.page_record(i, "u", html if i == 2 else b"<p>page</p>" * 40, None) for i in range(5)]
    if damage == "version":
        parts[2] = b"X" + parts[2][1:]
    elif damage == "header":
        parts[2] = parts[2].replace(b"Content-Length: ", b"Content-Length; ", 2).replace(b"WARC-Date: ", b"WARC-Date; ", 1)
    else:
        parts[2] = parts[2].replace(b"<pre>", b"<prE>", 1)
    data = w.member(b"".join(parts)) if zipped else b"".join(parts)
    found = list(w.salvage(io.BytesIO(data), len(data)))
    assert ids(found) == [0, 1, 3, 4]
    tiles(found, len(data))
    gap = next(x for x in found if x[0] == "gap")
    assert (gap[5:] if zipped else gap[1:3]) == (sum(map(len, parts[:2])), len(parts[2]))


@pytest.mark.parametrize("seed", range(40))
def test_whatever_is_damaged_places_cover_the_file(seed):
    rng = random.Random(seed)
    pages = [rng.randbytes(rng.choice([0, 30, 3000])) + rng.choice([b"", TEN[0][:500], b"WARC/1.1\r\n", b"\x1f\x8b\x08"]) for _ in range(12)]
    parts = [w.page_record(i, "u", p, None) for i, p in enumerate(pages)]
    groups = [parts[i : i + rng.choice([1, 3])] for i in range(0, 12, 3)]
    data = bytearray(b"".join(w.member(b"".join(g)) for g in groups) if seed % 2 else b"".join(parts))
    for _ in range(rng.randint(1, 6)):
        at, n = rng.randrange(len(data)), rng.choice([1, 5, 200])
        if rng.random() < 0.5:
            del data[at : at + n]
        else:
            data[at : at + n] = rng.randbytes(n)
    found = list(w.salvage(io.BytesIO(bytes(data)), len(data)))
    tiles(found, len(data))
    assert sum(x[0] == "record" for x in found) <= 12  # headers have no digest, so ids may be damaged
