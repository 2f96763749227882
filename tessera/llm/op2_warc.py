"""WARC archives of web pages: a writer with revisit records and a salvage reader.

Writing: one gzip member a record.  Of records with equal payloads of at least ``REVISIT_BYTES`` the
one with the largest page_id is a response and the others revisit it.

Reading: each record is checked (gzip CRC, version line, headers, length, closing blank lines, block
and payload digests).  After a failed check the reader goes on at the next member that opens with a
version line or, in plain archives and inside a member, at the next version line from which reading may go on, and
logs the bytes between as a quarantined gap with its reason.  A place is (offset, length) in the file and, inside a
member, (inner offset, inner length) in what it inflates to; records and gaps do not overlap and together are the whole
file and the whole of each member.

* A record whose frame holds but whose digest or version line does not is a gap of exactly its own bytes.
* Of a broken member all that can be inflated is read; only the bytes beyond its last record are a gap.
* Reading goes on at a version line only if the record there has headers and closing, leads to the end of the data or to
  the next record, and a blank line stands before it or its block digest holds.  Text in a payload that looks like
  a record is therefore not taken for one, unless it is a whole record that ends where its page ends, and the headers of
  its page are damaged too: then nothing tells them apart.
* Members are inflated as a stream: what is held is one record and a search window, not the member.

Defined results: a null html is an empty payload; a null page_id is smaller than any other and is
written without id; rows that share the largest page_id of their payload are all responses; a null url
has no target header, and other urls are percent-encoded where bytes are not printable ASCII; an empty
table writes no archive and gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, new_folder, small, table
from tessera.llm.files import NewFile, open_input

REVISIT_BYTES = 1000
#: Compressed bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
_URN = "urn:tessera:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes that are read first in search of the end of a line; the reader goes on as far as needed.
_LINE_BYTES = 1 << 12
_CHUNK = 1 << 18
#: Blocks longer than this are read only once their end is seen, and members longer than this are given out as they are read.
_PEEK_BYTES = 16 << 20


class Broken(ValueError):
    """A failed check; ``end`` is where the record ends if its frame holds."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


# ---------------------------------------------------------------- writing


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Payload-Digest", _sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", "") + "%")))
    own = f"{_URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    if refers_to is None:
        return record("response", own, http + payload, headers)
    return record("revisit", own, http, [*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_URN}{refers_to}>")])


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, refers_to (null: response)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    alone = F.concat(F.lit("alone-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    pages = pages.withColumn("_key", F.when(F.octet_length(body) >= least, F.sha2(body, 256)).otherwise(alone))
    # only payloads that occur more than once; partial sums meet a hot payload
    repeated = cut(pages.where(F.octet_length(body) >= least).groupBy("_key").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    joined = pages.join(small(repeated), "_key", "left")
    revisits = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisits, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html, refers_to); returns the manifest: path, records, bytes."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, done = None, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                if out is None:
                    out, n = NewFile(folder, "pages", ".warc.gz"), 0
                    out.write(member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"software: tessera\r\nformat: WARC file version 1.1\r\n", [("Content-Type", "application/warc-fields")])))
                out.write(member(page_record(page_id, url, (html or "").encode(), refers_to)))
                n += 1
                if out.size >= archive_bytes:
                    out.close()
                    done.append((out.path, n, out.size))
                    out = None
        if out is not None:
            out.close()
            done.append((out.path, n, out.size))
        for path, n, size in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return pages.mapInArrow(write, "path string, records long, bytes long")


# ---------------------------------------------------------------- reading


class Plain:
    """The bytes of an archive that is not compressed."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size

    def read(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; fewer only where the data end."""
        self.f.seek(at)
        return self.f.read(max(0, min(n, self.size - at)))

    peek = read

    def forget(self, before: int) -> None:
        pass


class Inflated:
    """What can be inflated of the gzip member at ``start``, as a stream: only what is between the record at hand
    and the last byte that was read is held."""

    def __init__(self, f, start: int):
        self.f, self.start = f, start
        self.unpacker, self.fed, self.tail = zlib.decompressobj(31), start, b""
        self.held, self.base = bytearray(), 0
        self.end: int | None = None  # of a whole member
        self.broken: str | None = None

    def _step(self, unpacker, fed: int, tail: bytes) -> tuple[bytes, int, bytes, str | None]:
        """Some more bytes, how much of the file was taken, what of it waits, and why it goes no further."""
        if not tail:
            self.f.seek(fed)
            tail = self.f.read(_CHUNK)
            fed += len(tail)
            if not tail:
                return b"", fed, b"", "truncated member"
        before = unpacker.copy()
        try:
            return unpacker.decompress(tail, _CHUNK), fed, unpacker.unconsumed_tail, None
        except zlib.error as e:  # the call gives nothing: again byte by byte
            out = bytearray()
            try:
                for i in range(len(tail)):
                    out += before.decompress(tail[i : i + 1])
            except zlib.error:
                pass
            return bytes(out), fed, b"", f"gzip: {e}"

    def _more(self) -> None:
        out, self.fed, self.tail, self.broken = self._step(self.unpacker, self.fed, self.tail)
        self.held += out
        if not self.broken and self.unpacker.eof:
            self.end = self.fed - len(self.unpacker.unused_data)

    def read(self, at: int, n: int) -> bytes:
        while self.base + len(self.held) < at + n and self.end is None and not self.broken:
            self._more()
        return bytes(self.held[at - self.base : at - self.base + n])

    def peek(self, at: int, n: int) -> bytes:
        """``read`` without holding what lies before ``at``: a copy of the inflater runs ahead."""
        place = self.base + len(self.held)
        if at < place or self.end is not None or self.broken:
            return self.read(at, n)
        unpacker, fed, tail, why, kept = self.unpacker.copy(), self.fed, self.tail, None, b""
        while place + len(kept) < at + n and not why and not unpacker.eof:
            out, fed, tail, why = self._step(unpacker, fed, tail)
            kept += out
            gone = min(max(0, at - place), len(kept))
            kept, place = kept[gone:], place + gone
        return kept[at - place : at - place + n]

    def forget(self, before: int) -> None:
        if before - self.base > _CHUNK:
            del self.held[: before - self.base]
            self.base = before

    def total(self) -> int:
        """Bytes that the member inflates to; reads it to its end."""
        while self.end is None and not self.broken:
            self._more()
            self.forget(self.base + len(self.held))
        return self.base + len(self.held)

    def taken(self, n: int) -> int:
        """Where in the file the first ``n`` inflated bytes are complete."""
        unpacker, fed, got = zlib.decompressobj(31), self.start, 0
        while got < n:
            self.f.seek(fed)
            chunk = self.f.read(1024)
            before = unpacker.copy()
            try:
                out = unpacker.decompress(chunk)
            except zlib.error:
                out = None
            if out is None or got + len(out) >= n:
                for i in range(len(chunk)):
                    got += len(before.decompress(chunk[i : i + 1]))
                    if got >= n:
                        return fed + i + 1
            got, fed = got + len(out), fed + len(chunk)
        return fed


def _opens_with_version(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _search(source: Plain | Inflated, at: int, mark: bytes, holds) -> int | None:
    """The first place from ``at`` on where ``mark`` stands and ``holds(place)``; None if there is none."""
    while data := source.read(at, _CHUNK + len(mark) - 1):
        found = data.find(mark)
        while found >= 0:
            if holds(at + found):
                return at + found
            found = data.find(mark, found + 1)
        if len(data) < _CHUNK + len(mark) - 1:
            return None
        at += _CHUNK
        source.forget(at - 4)
    return None


def _line(at: int, read) -> bytes:
    """The line at ``at`` without its end, however long it is."""
    n = _LINE_BYTES
    while True:
        data = read(at, n)
        end = data.find(b"\r\n")
        if end >= 0:
            return data[:end]
        if len(data) < n:
            raise Broken("headers do not end")
        n *= 2


def _headers(at: int, read) -> tuple[dict[str, str], int, int]:
    """Headers (lower-case names) of the lines from ``at`` to a blank one, where the block begins and its length."""
    headers = {}
    while line := _line(at, read):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Broken("bad header line")
        headers[name.strip().lower()] = value.strip()
        at += len(line) + 2
    if not headers.get("content-length", "").isdecimal():
        raise Broken("bad content length")
    return headers, at + 2, int(headers["content-length"])


def _window(source: Plain | Inflated, at: int):
    """A reader of what lies from ``at`` on, which is fetched once and held no longer than the reader."""
    held = b""

    def read(place: int, n: int) -> bytes:
        nonlocal held
        if place + n - at > len(held):
            held = source.peek(at, max(place + n - at, 2 * len(held), _LINE_BYTES))
        return held[place - at : place - at + n]

    return read


def _leads_on(source: Plain | Inflated, at: int) -> bool:
    """At ``at`` the data end or a record begins, though its version line may be damaged."""
    read = _window(source, at)
    head = read(at, 10)
    if not head or _VERSION.match(head):
        return True
    try:
        _headers(at + len(_line(at, read)) + 2, read)
    except Broken:
        return False
    return True


def _frame(source: Plain | Inflated, at: int) -> int | None:
    """Where the record at ``at`` ends whose headers hold, that is closed and leads on; its version line is not looked at."""
    read = _window(source, at)
    try:
        _, start, n = _headers(at + len(_line(at, read)) + 2, read)
    except Broken:
        return None
    end = start + n + 4
    return end if source.peek(end - 4, 4) == b"\r\n\r\n" and _leads_on(source, end) else None


def _after_no_version(source: Plain | Inflated, at: int) -> int | None:
    """Where what has no version line at ``at`` ends, if that can be told: at a version line after junk in the same line, or
    with the frame that its headers tell."""
    try:
        junk = _line(at, _window(source, at)).rfind(b"WARC/1.")
    except Broken:
        return None
    return at + junk if junk > 0 and _restarts(source, at + junk) else _frame(source, at)


def _restarts(source: Plain | Inflated, at: int) -> bool:
    """A version line from which reading may go on: the frame holds, and a blank line stands before it or, where junk does, the
    block has the digest that its headers tell."""
    if not _VERSION.match(source.peek(at, 10)) or _frame(source, at) is None:
        return False
    if source.read(max(at - 3, 0), min(at, 3)) in (b"\n\r\n", b""):
        return True
    try:
        return "warc-block-digest" in _parse(source, at)[0]
    except Broken:
        return False


def _parse(source: Plain | Inflated, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if not _VERSION.match(source.read(at, 10)):
        raise Broken("no version line", _after_no_version(source, at))
    headers, start, n = _headers(at + 10, source.read)
    end = start + n + 4
    tail = (source.peek if n > _PEEK_BYTES else source.read)(end - 4, 4)
    if tail != b"\r\n\r\n":
        raise Broken("record is not closed" if len(tail) == 4 else "record runs past the end")
    block = source.read(start, n)
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"] != _sha1(block):
        raise Broken("block digest differs", end)
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", "").startswith("sha1:") and headers["warc-payload-digest"] != _sha1(block.partition(b"\r\n\r\n")[2]):
        raise Broken("payload digest differs", end)
    return headers, block, end


def _pieces(source: Plain | Inflated) -> Iterator[tuple]:
    """(kind, begin, end, headers or reason, block) of all records and gaps; the end of a last gap is None, that of the data."""
    at = 0
    while source.read(at, 1):
        try:
            headers, block, end = _parse(source, at)
            yield "record", at, end, headers, block
        except Broken as e:
            end = e.end or _search(source, at + 1, b"WARC/1.", lambda place: _restarts(source, place))
            yield "gap", at, end, e.reason, None
            if end is None:
                return
        at = end
        source.forget(at - 4)


def _plain(f, size: int) -> Iterator[tuple]:
    for kind, begin, end, what, block in _pieces(Plain(f, size)):
        yield kind, begin, (size if end is None else end) - begin, what, block, None, None


def _inside(source: Inflated, ends: dict) -> Iterator[tuple]:
    """The records and gaps of a member; ``ends`` gets the end of the last one and, at last, the reason why nothing follows."""
    for kind, begin, end, what, block in _pieces(source):
        if end is None:
            ends["reason"] = what
            return
        ends["done"] = end
        yield kind, what, block, begin, end - begin


def _extent(file: Plain, source: Inflated, done: int) -> tuple[int, int]:
    """Where the file bytes that hold the first ``done`` inflated bytes of a member end, and where the next member begins."""
    source.total()
    if not source.broken:
        return source.end, source.end
    first = source.taken(done) if done else source.start
    found = _search(file, max(first, source.start + 1), b"\x1f\x8b\x08", lambda place: _opens_with_version(file.read(place, 2048)))
    return first, file.size if found is None else found


def _zipped(f, size: int) -> Iterator[tuple]:
    """Records and gaps inside a member have its place in the file and their own in what it inflates to.  Of a broken
    member those that can be read are taken; the bytes of the file beyond the last of them are a gap."""
    at, file = 0, Plain(f, size)
    while at < size:
        source, ends, waiting, held, extent = Inflated(f, at), {"done": 0}, [], 0, None
        for item in _inside(source, ends):
            waiting.append(item)
            held += item[-1]
            if extent is None and held > _PEEK_BYTES:  # a long member: its extent by a run of its own
                ahead, last = Inflated(f, at), {"done": 0}
                for _ in _inside(ahead, last):
                    pass
                extent = _extent(file, ahead, last["done"])
            if extent:
                for kind, what, block, begin, n in waiting:
                    yield kind, at, extent[0] - at, what, block, begin, n
                waiting = []
        first, after = extent or _extent(file, source, ends["done"])
        rest = source.total() - ends["done"]
        if not source.broken and (rest or not ends["done"]):
            waiting.append(("gap", ends.get("reason", "empty member"), None, ends["done"], rest))
        for kind, what, block, begin, n in waiting:
            yield kind, at, first - at, what, block, begin, n
        if source.broken:
            yield "gap", first, after - first, source.broken, None, None, None
        at = after


def _is_zipped(f, size: int) -> bool:
    head, file = f.read(5), Plain(f, size)
    if head == b"WARC/" or head[:2] == b"\x1f\x8b":
        return head != b"WARC/"
    member_at = _search(file, 0, b"\x1f\x8b\x08", lambda place: _opens_with_version(file.read(place, 2048)))
    line_at = _search(file, 0, b"WARC/1.", lambda place: _VERSION.match(file.read(place, 10)))
    return member_at is not None and (line_at is None or member_at < line_at)


def salvage(f, size: int) -> Iterator[tuple]:
    """("record", offset, length, headers, block, inner offset, inner length) and ("gap", offset, length, reason, None, inner
    offset, inner length), in order; the inner ones are None where the file's own bytes are meant."""
    gap = None
    f.seek(0)
    for item in (_zipped if _is_zipped(f, size) else _plain)(f, size):
        if item[0] == "gap" and gap:
            # a failed restart belongs to the gap before
            if item[5] is None and gap[5] is None and gap[1] + gap[2] == item[1]:
                gap = ("gap", gap[1], gap[2] + item[2], gap[3], None, None, None)
                continue
            if None not in (item[5], gap[5]) and gap[1] == item[1] and gap[5] + gap[6] == item[5]:
                gap = (*gap[:6], gap[6] + item[6])
                continue
        if gap:
            yield gap
            gap = None
        if item[0] == "gap":
            gap = item
        else:
            yield item
    if gap:
        yield gap


_ID = re.compile(rf"<?{_URN}(-?\d+)>?\Z")
READ = "path string, offset long, length long, inner_offset long, inner_length long, kind string, reason string, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _row(path: str, item: tuple, with_payload: bool) -> dict:
    kind, offset, length, what, block, inner_offset, inner_length = item
    row = dict.fromkeys(c.split()[0] for c in READ.split(", ")) | {"path": path, "offset": offset, "length": length, "inner_offset": inner_offset, "inner_length": inner_length, "kind": kind}
    if kind == "gap":
        return row | {"reason": what}
    ref = lambda name: int(m[1]) if (m := _ID.match(what.get(name, ""))) else None
    row |= {"record_type": what.get("warc-type"), "page_id": ref("warc-record-id"), "url": what.get("warc-target-uri"), "refers_to": ref("warc-refers-to")}
    if row["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if with_payload else None}
    elif row["record_type"] == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", block)
        digest = what.get("warc-payload-digest", "").removeprefix("sha1:")
        row |= {"payload_bytes": int(found[1]) if found else None, "payload_digest": base64.b32decode(digest).hex() if digest else None}
    return row


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in column ``path`` of ``manifest`` (checkpointed)."""
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ.split(", ")])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_input(path) as f:
                    for item in salvage(f, f.size()):
                        rows.append(_row(path, item, with_payload))
                        held += item[2] or 0
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, READ)
    return out.select(*names)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = cut(write_archives(with_revisits(table(spark, sf_dir, "pages")), new_folder(spark, "op2")))
    return all_pages(manifest, read_archives(manifest, with_payload=False))


def all_pages(manifest: DataFrame, read: DataFrame) -> DataFrame:
    """The pages of ``read``; fails if they are not as many as were written."""
    records = read.where("kind = 'record' AND record_type IN ('response', 'revisit')")
    records = cut(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    written, found = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if written != found:
        raise ValueError(f"{written} records were written, {found} read")
    return records


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), r AS (
  SELECT page_id, html, CASE WHEN strlen(html) >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
