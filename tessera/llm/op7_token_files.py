"""Token-id files in Simple-8b: written in ascending doc_id order, read back by block.

A file is a magic, blocks of ``BLOCK`` ids (the last may be shorter), the index and a trailer.  The
index holds the place of each block, so that any block decodes by itself with vector operations, and
doc_id and number of ids of each document; the trailer says where the index begins.

Defined results: null and empty texts hold only the end id; null doc_ids come first; rows of equal
doc_id follow each other by a hash of the text; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import simple8b, tokens
from tessera.llm.common import cut, new_folder, table
from tessera.llm.files import NewFile, open_input

MAGIC = b"TESS8B01"
BLOCK = 16_384
END_ID = 2
_TRAILER = struct.Struct("<QQQQ8s")  # place of the index, blocks, documents, ids, magic


class IdFileWriter:
    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.blocks, self.doc_ids, self.known, self.counts = [], [], [], []
        self._wait, self._waiting, self.ids = [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(ids))
        self.ids += len(ids)
        self._wait.append(ids)
        self._waiting += len(ids)
        if self._waiting >= 8 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._wait) if self._wait else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            data = simple8b.encode_block(ids[a : min(whole, a + BLOCK)]).astype("<u8").tobytes()
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self._wait, self._waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.blocks, "<u8"), (self.doc_ids, "<i8"), (self.known, "u1"), (self.counts, "<u8")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(_TRAILER.pack(self.at, len(self.blocks), len(self.doc_ids), self.ids, MAGIC))
        self.out.close()


def read_id_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document, a block in memory at a time besides the index."""
    with open_input(path) as f:
        size = f.size()
        f.seek(size - _TRAILER.size)
        index, n_blocks, n_docs, _, magic = _TRAILER.unpack(f.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a finished token-id file")
        f.seek(index)
        places = np.frombuffer(f.read(8 * n_blocks), "<u8").tolist() + [index]
        doc_ids = np.frombuffer(f.read(8 * n_docs), "<i8").tolist()
        known = np.frombuffer(f.read(n_docs), "u1").tolist()
        counts = np.frombuffer(f.read(8 * n_docs), "<u8").tolist()
        have, block = np.zeros(0, np.uint64), 0
        for doc_id, there, n in zip(doc_ids, known, counts):
            parts, missing = [], n
            while True:
                parts.append(have[:missing])
                have, missing = have[missing:], missing - len(parts[-1])
                if not missing:
                    break
                f.seek(places[block])
                have = simple8b.decode_block(np.frombuffer(f.read(places[block + 1] - places[block]), "<u8"))
                block += 1
            yield (doc_id if there else None), (np.concatenate(parts) if len(parts) > 1 else parts[0])


def write_id_files(docs: DataFrame, folder: str, vocabulary: str = tokens.VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One file a range of doc_ids.  Returns the manifest: part, path, n_docs, n_ids, in order of part."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, writer = tokens.encoder(vocabulary), np.array([end_id], "<u4"), TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows and writer is None:
                target = NewFile(folder, f"ids-{part:06d}", ".s8b")
                writer = IdFileWriter(target)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 1000):
                for doc_id, raw in zip(ids[at : at + 1000], encoder.encode(texts[at : at + 1000].to_pylist())):
                    writer.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4"), end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [target.path], "n_docs": [len(writer.counts)], "n_ids": [writer.ids]})

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "part long, path string, n_docs long, n_ids long")


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``manifest`` (checkpointed)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in read_id_file(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = max(1, manifest.count())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=list(names))


def op7_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = cut(write_id_files(table(spark, sf_dir, "documents"), new_folder(spark, "op7")))
    return read_back(manifest)
