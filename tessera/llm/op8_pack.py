"""Best-fit packing by minimum bin slack.

Only the lengths of the pieces decide, and there are at most ``CAPACITY`` of them, so the search runs
on counts by length, which stay as small however large the corpus is.  Each bin is opened with the
longest length left; a bitset subset-sum over the lengths still available finds the fullest feasible
combination; it is taken as often as the counts allow and removed.  Pieces are then numbered within
their length, and an interval table of the combinations says where each number goes.

Defined results: null and empty texts are one piece with the end id only; an empty table gives no
rows; repeated rows are packed each by itself; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import cut, numbered, table

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; of a long document the first piece is the short one."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: tuple[list, ...] = ([], [], [], [], [])
            for at in range(0, len(ids), 1000):
                for doc_id, raw in zip(ids[at : at + 1000], encoder.encode(texts[at : at + 1000].to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    for i, a in enumerate([0, *range(first, n, capacity)]):
                        b = first if not i else a + capacity
                        for column, value in zip(out, (doc_id, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, _PIECES)


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of (length, count), longest first: the combination with the largest sum of at most ``room``."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length, count in available:
        count, part = min(count, room // length) if length <= room else 0, 1
        while count and not reach >> room & 1:
            part = min(part, count)
            layers.append((length, part, reach))
            reach |= reach << part * length & mask
            count -= part
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(layers):
        if not before >> total & 1:
            total -= part * length
            chosen[length] = chosen.get(length, 0) + part
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination as length -> count, how many bins hold it)."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        combination = fullest(sorted(((k, v) for k, v in left.items() if v), reverse=True), capacity - seed)
        left[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((combination, times))
    return out


def intervals(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first sequence, pieces of that length in a bin, offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for combination, times in bins:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            at = used.get(length, 0)
            out.append((length, at, at + n * times, sequence, n, offset))
            used[length] = at + n * times
            offset += n * length
        sequence += times
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, capacity, **options))
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most `capacity` rows
    where = spark.createDataFrame(intervals(minimum_bin_slack(counts, capacity)), "_length long, _lo long, _hi long, _seq long, _per long, _offset long")
    placed = numbered(cut_up, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    placed = placed.join(F.broadcast(where), F.expr("length = _length AND _rank >= _lo AND _rank < _hi"))  # rows: bounded by the lengths
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("_seq + (_rank - _lo) div _per").alias("sequence_id"), F.expr("_offset + (_rank - _lo) % _per * length").alias("offset"),
    )


def op8_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
