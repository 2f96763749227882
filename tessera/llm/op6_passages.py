"""Substring deduplication with repeated-phrase automata.

A window is ``WINDOW`` words; a word goes if a window over it also starts in a document of smaller id.

Only one exchange moves all texts (compressed); later ones move documents that share something.

0. Of documents of equal words all but the smallest id lose every word and take no further part.
1. Every window is represented by the least hash of the ``PHRASE``-word runs in it, so equal windows
   share a representative and neighbours mostly do; those that occur in two documents are kept.
2. Windows with such a representative are counted by hash: recurring ones belong to the smallest
   document that has them, their keeper.
3. In the keepers recurring windows are joined to passages and cut into segments of ``SEGMENT`` windows
   (with their words, so nothing rests on hashes from here on).
4. Each document is sent the segments that its own windows point to, never all.  A task takes documents
   in shards; of each shard's segments every ``WINDOW - PHRASE + 1``-th phrase goes into an Aho-Corasick
   automaton over word numbers (any window holds one of them whole), all its documents are streamed
   through it, and each hit is grown along its diagonal to the longest equal run.  Runs of a window or
   more with a smaller id are removed.

Hot passages meet partial sums and joins that adaptive execution splits; the list sent to a document is
bounded by its own length.  Defined results: a null doc_id ranks after all others; documents of one id
do not remove from each other; null and empty texts have no words; an empty table gives no rows; other
columns pass through ``deduplicated`` by name and are not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, small, stored, table, word_count
from tessera.llm.wordhash import WORD, Runs, hashes, rolling_min

WINDOW = 50
PHRASE = 16
SEGMENT = 128
#: Words of documents that are hashed together.
WORDS_AT_ONCE = 200_000
#: Documents whose segments share an automaton.
SHARD = 400
LAST_ID = (1 << 63) - 1
_INT64 = pa.int64()


def _keys(id_name: str = "id", hash_name: str = "text_hash") -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(id_name), F.xxhash64(F.coalesce("text", F.lit(""))).alias(hash_name)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[str]]]]:
    """(from, to, words) for stretches of the batch's documents; column 2 is the text."""
    start, words, n = 0, [], 0
    for i, text in enumerate(batch.column(2)):
        found = WORD.findall(text.as_py() or "")
        words.append(found)
        n += len(found)
        if n >= WORDS_AT_ONCE:
            yield start, i + 1, words
            start, words, n = i + 1, [], 0
    if words:
        yield start, batch.num_rows, words


def _names(batch: pa.RecordBatch) -> list[np.ndarray]:
    """A document goes by its id and the hash of its text, so that ids which many share gather nothing."""
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]


def _named(names: list[np.ndarray], docs: np.ndarray) -> list[pa.Array]:
    return [pa.array(column[docs], _INT64) for column in names]


class Windows:
    """All windows of some documents: document, place, representative and hash."""

    def __init__(self, words: list[list[str]], with_hash: bool = True):
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        own = np.frombuffer(b"".join(hashes(w) for w in words), np.uint64)
        runs = Runs(own)
        self.doc = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(own))
        whole = (place + WINDOW <= np.repeat(ends, sizes))[: max(0, len(own) - WINDOW + 1)]
        self.at = (place - np.repeat(ends - sizes, sizes))[: len(whole)][whole]
        self.doc = self.doc[: len(whole)][whole]
        least = rolling_min(runs.of(PHRASE), WINDOW - PHRASE + 1)
        self.anchor = least[whole].view(np.int64)
        self.hash = runs.of(WINDOW)[whole].view(np.int64) if with_hash else None


def _anchors(docs: DataFrame) -> DataFrame:
    """id, text_hash, anchor: the distinct representatives of each document's windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _names(batch)
            for start, end, words in _blocks(batch):
                w = Windows(words, False)
                new = np.ones(len(w.doc), bool)
                new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])
                yield pa.RecordBatch.from_arrays([*_named(names, start + w.doc[new]), pa.array(w.anchor[new])], names=["id", "text_hash", "anchor"])

    return docs.mapInArrow(run, "id long, text_hash long, anchor long")


def _members(lists: pa.Array, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Document (from 0) and value of every list entry of a stretch."""
    part = lists.slice(start, end - start)
    sizes = np.array([len(x) for x in part])
    return np.repeat(np.arange(end - start), sizes), part.flatten().to_numpy(zero_copy_only=False)


def _among(doc: np.ndarray, value: np.ndarray, in_doc: np.ndarray, in_value: np.ndarray) -> np.ndarray:
    """Which (doc, value) are in the lists."""
    known, number = np.unique(in_value, return_inverse=True)
    slot = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
    here = known[slot] == value if len(known) else np.zeros(len(value), bool)
    pairs = np.unique(in_doc * len(known) + number)
    wanted = doc * len(known) + slot
    at = np.minimum(np.searchsorted(pairs, wanted), max(0, len(pairs) - 1))
    return here & (pairs[at] == wanted) if len(pairs) else here


def _first(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which rows are the first of their (doc, value)."""
    order = np.lexsort((value, doc))
    new = np.ones(len(doc), bool)
    new[order[1:]] = (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])
    return new


def _candidates(docs: DataFrame) -> DataFrame:
    """``docs``: id, text_hash, text, anchors.  w, id, text_hash of each window whose representative is in the list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _names(batch)
            for start, end, words in _blocks(batch):
                w = Windows(words)
                yes = _among(w.doc, w.anchor, *_members(batch.column(3), start, end))
                doc, hashed = w.doc[yes], w.hash[yes]
                once = _first(doc, hashed)
                yield pa.RecordBatch.from_arrays([pa.array(hashed[once]), *_named(names, start + doc[once])], names=["w", "id", "text_hash"])

    return docs.mapInArrow(run, "w long, id long, text_hash long")


def _segments(docs: DataFrame) -> DataFrame:
    """``docs``: id, text_hash, text, ws (recurring windows kept here).  keeper, segment, phrase, ws: the segments of
    the passages with their windows; ``segment`` is a hash of the words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, end, words in _blocks(batch):
                w = Windows(words)
                yes = _among(w.doc, w.hash, *_members(batch.column(3), start, end))
                doc, at, hashed = w.doc[yes], w.at[yes], w.hash[yes]
                once = _first(doc, hashed)  # a window points to one segment
                border = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) != 1)) + 1
                out: tuple[list, ...] = ([], [], [], [])
                for a, b in zip([0, *border.tolist()], [*border.tolist(), len(doc)]):
                    for c in range(a, b, SEGMENT):
                        d = min(b, c + SEGMENT)
                        phrase = " ".join(words[doc[c]][at[c] : at[d - 1] + WINDOW])
                        own = int.from_bytes(hashlib.blake2b(phrase.encode(), digest_size=8).digest(), "big", signed=True)
                        for column, value in zip(out, (ids[start + doc[c]], own, phrase, hashed[c:d][once[c:d]])):
                            column.append(value)
                kinds = (_INT64, _INT64, pa.string(), pa.list_(_INT64))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["keeper", "segment", "phrase", "ws"])

    return docs.mapInArrow(run, "keeper long, segment long, phrase string, ws array<long>")


class Shard:
    """The automaton of some segments (keeper, words)."""

    STRIDE = WINDOW - PHRASE + 1

    def __init__(self, segments: dict[tuple[int, int], str]):
        self.numbers: dict[str, int] = {}
        self.segments = [(keeper, np.array([self.numbers.setdefault(x, len(self.numbers) + 1) for x in phrase.split(" ")])) for (keeper, _), phrase in segments.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for s, (_, own) in enumerate(self.segments):
            for p in range(0, len(own) - PHRASE + 1, self.STRIDE):
                key = tuple(own[p : p + PHRASE].tolist())
                places = self.automaton.get(key, None)
                if places is None:
                    self.automaton.add_word(key, places := [])
                places.append((s, p))
        self.automaton.make_automaton()

    def covered(self, doc_id: int, words: list[str]) -> np.ndarray:
        """Words inside a run of a window or more that a segment of a smaller id has too."""
        own = [self.numbers.get(x, 0) for x in words]
        text, out, done = np.array(own), np.zeros(len(words), bool), set()
        for last, places in self.automaton.iter(tuple(own)):
            for s, p in places:
                keeper, other = self.segments[s]
                shift = last - PHRASE + 1 - p  # the segment's first word stands here in the document
                if keeper >= doc_id or (s, shift) in done:
                    continue
                done.add((s, shift))
                a, b = max(0, shift), min(len(text), shift + len(other))
                unequal = np.flatnonzero(text[a:b] != other[a - shift : b - shift])
                edges = np.concatenate([[-1], unequal, [b - a]])
                for k in np.flatnonzero(np.diff(edges) > WINDOW):
                    out[a + edges[k] + 1 : a + edges[k + 1]] = True
        return out


def _apply(docs: DataFrame, with_text: bool) -> DataFrame:
    """``docs``: id, text_hash, text, segments.  What is left of the documents that lose words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                yield _shard(batch.slice(at, SHARD))

    def _shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        shard = Shard({(s["keeper"], s["segment"]): s["phrase"] for found in batch.column(3).to_pylist() for s in found})
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, text in enumerate(batch.column(2)):
            words = WORD.findall(text.as_py() or "")
            gone = shard.covered(ids[i], words)
            if gone.any():
                left = " ".join([w for w, g in zip(words, gone.tolist()) if not g])
                for column, value in zip(out, (ids[i], hashed[i], int(gone.sum()), hashlib.sha256(left.encode()).hexdigest(), left if with_text else None)):
                    column.append(value)
        kinds = (_INT64, _INT64, _INT64, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "text_hash", "n", "sha", "left"])

    return docs.mapInArrow(run, "id long, text_hash long, n long, sha string, left string")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text_hash, text) with the text compressed for the exchange."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([pack((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["id", "text_hash", "packed"])

    return docs.mapInArrow(run, "id long, text_hash long, packed binary")


def _unpacked(docs: DataFrame) -> DataFrame:
    """``docs``: id, text_hash, packed, anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                text = pa.array([unpack(t.as_py()).decode() for t in part.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, part.column(3)], names=["id", "text_hash", "text", "anchors"])

    return docs.mapInArrow(run, "id long, text_hash long, text string, anchors array<long>")


def _whole(docs: DataFrame, *more: Column) -> DataFrame:
    """id, text_hash, n_words and the digest of all words of each row, by DataFrame functions."""
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return docs.select(*_keys(), word_count(F.col("text")).alias("n_words"), F.sha2(joined, 256).alias("whole_sha"), *more)


def changes(docs: DataFrame, whole: DataFrame, with_text: bool = False) -> DataFrame:
    """id, text_hash, n (words removed), sha and, if asked for, left (the text) of the documents that lose
    words, checkpointed.  ``whole``: checkpointed rows of ``_whole``."""
    folders: list[str] = []
    # documents of equal words: all but the smallest id lose everything, and take no further part
    groups = cut(whole.where(F.col("n_words") >= WINDOW).groupBy("whole_sha").agg(F.min("id").alias("lo"), F.count("*").alias("rows")).where("rows > 1").select("whole_sha", "lo"))
    marked = whole.join(small(groups), "whole_sha", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("lo"), F.lit(False)))
    copies = cut(marked.where("copy").select("id", "text_hash", F.col("n_words").alias("n")).distinct())
    same_id = whole.groupBy("id").agg(F.count_distinct("text_hash").alias("texts"))
    alone = copies.join(small(same_id.where("texts > 1").select("id")), "id", "left_anti").select("id")

    base = docs.select(*_keys(), "text")
    anchors = stored(_anchors(base).join(small(cut(alone)), "id", "left_anti").distinct(), "op6-anchors", folders)
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    lists = cut(anchors.join(shared, "anchor").groupBy("id", "text_hash").agg(F.collect_set("anchor").alias("anchors")))

    # the one exchange of all texts; from here on only documents that share something
    some = stored(_unpacked(_packed(base).join(lists, ["id", "text_hash"]).select("id", "text_hash", "packed", "anchors")), "op6-candidates", folders)
    windows = stored(_candidates(some), "op6-windows", folders)
    kept = windows.groupBy("w").agg(F.min(F.struct("id", "text_hash")).alias("lo"), F.max("id").alias("hi")).where("lo.id < hi")
    keepers = kept.groupBy("lo.id", "lo.text_hash").agg(F.collect_set("w").alias("ws"))
    segments = stored(_segments(some.select("id", "text_hash", "text").join(keepers, ["id", "text_hash"])), "op6-segments", folders)
    pointers = segments.select("keeper", "segment", F.explode("ws").alias("w"))
    wanted = windows.join(pointers, "w").where("id > keeper").select("id", "text_hash", "keeper", "segment").distinct()
    phrases = segments.select("keeper", "segment", "phrase").distinct()
    sent = wanted.join(phrases, ["keeper", "segment"]).groupBy("id", "text_hash").agg(F.collect_list(F.struct("keeper", "segment", "phrase")).alias("segments"))
    out = _apply(some.select("id", "text_hash", "text").join(sent, ["id", "text_hash"]), with_text)
    nothing = copies.select("id", "text_hash", "n", F.sha2(F.lit(""), 256).alias("sha"), F.lit("" if with_text else None).cast("string").alias("left"))
    out = cut(out.unionByName(nothing).dropDuplicates(["id", "text_hash"]))
    discard(docs.sparkSession, folders)
    return out


def deduplicated(docs: DataFrame, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: doc_id) with _n_words, _n_removed, _kept_sha256 and, if
    asked for, _kept_text (the text itself where nothing was removed)."""
    names = carry or ["doc_id"]
    own = F.struct(*[docs[c] for c in names]).alias("_own")
    whole = cut(_whole(docs, own)) if names == ["doc_id"] else cut(_whole(docs))
    changed = changes(docs, whole.select("id", "text_hash", "n_words", "whole_sha"), with_text)
    if names == ["doc_id"] and not with_text:
        rows = whole
    else:
        rows = _whole(docs, own, F.col("text").alias("_text"))
    rows = rows.join(changed, ["id", "text_hash"], "left")
    out = [F.col("n_words").alias("_n_words"), F.coalesce("n", F.lit(0)).cast("long").alias("_n_removed"), F.coalesce("sha", "whole_sha").alias("_kept_sha256")]
    return rows.select("_own.*", *out, *([F.coalesce("left", "_text").alias("_kept_text")] if with_text else []))


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")])


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS lo FROM windows) WHERE doc_id > lo
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM again
), left_over AS (
  SELECT w.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN left_over l USING (doc_id)
"""
