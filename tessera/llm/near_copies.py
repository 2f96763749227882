"""SimHash near copies by a similarity: operator 9 where links are exact Jaccard similarities, not bits.

Links join texts whose lower-cased (A-Z) word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
At 0.8 about ten of 64 bits of a text's fingerprint differ, far beyond what covering masks can
guarantee, so a text has several SimHash fingerprints, and a pair is a candidate if any two meet:

* of all its shingles, in the covering tables of operator 9 (every pair within ``RADIUS`` bits meets);
* of ``SAMPLES`` samples of its shingles, which must agree in all bits.  A sample is what falls into one
  of G hash slots; G is such that a slot holds ``SLOT`` to 1.42 * ``SLOT`` shingles on average, and a text near the
  end of a size class is also sampled as the next larger class, so that both of a pair are in one.  A
  pair of similarity 0.8 shares each sample with probability 0.35 or more.

Each pair is decided on the whole sets.  Work is on distinct sets (nodes), in two rounds: in every bucket
all are compared with the member that shares most; then members of buckets that hold several components
are joined by the rarest of their shingles (a prefix filter, which loses no pair).  What is left out is
linked or cannot be, so the components are those of all pairs that meet in a bucket, and no step grows with
the square of a group of near copies.

Defined results: a text of fewer than ``SHINGLE`` words is one shingle; null, empty and white-space
texts are copies of each other; a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard, small, stored
from tessera.llm.components import stars
from tessera.llm.op9_simhash import RADIUS, covering_masks
from tessera.llm.wordhash import WORD, Runs, hashes

SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction of whole numbers.
SIMILARITY = (4, 5)
SAMPLES, SLOT = 16, 3.0
_ODD, _MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words."""
    words = WORD.findall(text.encode().lower().decode()) if text else []  # bytes.lower: A-Z only
    own = np.frombuffer(hashes(words), np.uint64)
    return np.unique(Runs(own).of(min(k, len(own)))) if len(own) else own


def node(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes())))) if len(found) else 0


def simhashes(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the groups of hashes that begin at ``starts``; a bit is 1 if set in over half."""
    out = np.zeros(len(starts), np.uint64)
    sizes = np.diff(np.append(starts, len(found)))
    for a, b in _runs(sizes):
        part = found[starts[a] : starts[a] + sizes[a:b].sum()]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones = np.add.reduceat(bits, starts[a:b] - starts[a], axis=0, dtype=np.int32)
        out[a:b] = np.packbits(2 * ones > sizes[a:b, None]).view(">u8")
    return out


def _runs(sizes: np.ndarray, most: int = 65_536) -> list[tuple[int, int]]:
    """Stretches of neighbouring groups of about ``most`` hashes."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)]))


def classes(n: int) -> list[tuple[int, int]]:
    """Size classes of a set of ``n`` shingles and their number of slots; sets of fewer than four have none,
    as they are similar to equal ones only."""
    if n < 4:
        return []
    least, of = SIMILARITY
    low, high = (max(0, int(np.floor(2 * np.log2(m / SLOT)))) for m in (n, n * of / least))
    return [(c, max(2, round(2 ** (c / 2)))) for c in sorted({low, high})]


def sample_keys(found: np.ndarray) -> np.ndarray:
    """One key a sample of two shingles or more: its class, place and fingerprint."""
    out = []
    for c, slots in classes(len(found)):
        for turn in range(-(-SAMPLES // slots)):
            mixed = (found ^ np.uint64(xxhash.xxh64_intdigest(bytes([turn])))) * _ODD
            mixed ^= mixed >> np.uint64(31)
            slot = ((mixed * _MIX >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            picked = slot < SAMPLES
            order = np.argsort(slot[picked], kind="stable")
            slot, mixed = slot[picked][order], mixed[picked][order]
            places, starts, counts = np.unique(slot, return_index=True, return_counts=True)
            if len(places):
                prints = simhashes(mixed, starts)
                out.append((prints * _MIX + np.uint64(c * 65_536 + turn * 256) + places.astype(np.uint64))[counts > 1])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), node, size (shingles), fp (fingerprint of all), keys (of the samples)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                nodes.append(node(found))
                sizes.append(len(found))
                prints.append(int(simhashes(found, np.zeros(1, int)).view(np.int64)[0]) if len(found) else 0)
                keys.append(sample_keys(found))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "h", "node", "size", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, node long, size long, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node, found (its shingles as bytes) of the texts that ``wanted`` (doc_id, h) names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t.as_py(), k) for t in batch.column(0)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(map(node, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "found"])

    wanted = small(wanted.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")))
    texts = docs.join(wanted, F.xxhash64("text").eqNullSafe(F.col("_h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_d")), "left_semi")
    return texts.select("text").mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    least, of = similarity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(of * both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = sets.select(F.col("node").alias("a"), F.col("found").alias("x")), sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, folders: list[str], similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """a < b of all pairs of ``nodes`` (node, size, root) in different components that may be similar.

    With the shingles of every node in one order, rarest among these nodes first, two similar sets share one within
    the first n - least * n / of + 1 of both, and at the first they share each has enough left for all
    that they must have in common.  What a common passage or a large group shares comes last in that order.
    Where many nodes of one component hold a shingle, only the others look for partners.
    """
    least, of = similarity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch.column(0)[i].as_py())), pa.array(found)], names=["node", "shingle"])

    held = nodes.join(sets, "node").select("node", "found").mapInArrow(run, "node long, shingle long")
    held = stored(held, "shingles", folders)
    common = held.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    known = stored(held.join(common, "shingle"), "common", folders)
    # shingles that one node holds alone come first and match nothing
    kept = known.groupBy("node").agg(F.count("*").alias("shared")).join(nodes, "node").where(f"{of} * shared >= {least} * size")
    place = F.row_number().over(Window.partitionBy("node").orderBy("holders", "shingle")) + F.col("size") - F.col("shared") - 1
    ranked = known.join(kept, "node").withColumn("place", place).where(f"{of} * place <= {of - least} * size")
    ranked = stored(ranked.select("shingle", "node", "size", "root", "place"), "prefixes", folders)
    by_root = ranked.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("most"))
    minor = ranked.join(by_root, "shingle").where("root <> most.root")
    other = ranked.select("shingle", F.col("node").alias("other"), F.col("size").alias("m"), F.col("root").alias("r"), F.col("place").alias("q"))
    enough = F.expr(f"{least + of} * least(size - place, m - q) >= {least} * (size + m)")
    fits = enough & F.expr(f"root <> r AND {of} * least(size, m) >= {least} * greatest(size, m)")
    return minor.join(other, "shingle").where(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct a < b of ``rows`` (one, its size and print, other, its size and print, table t) that may be
    similar by their sizes, and in a covering table by fingerprints within the radius."""
    least, of = SIMILARITY
    fits = (F.least("n", "m") * of >= F.greatest("n", "m") * least) & (F.col("t").isNull() | (F.bit_count(F.expr("fp ^ fq")) <= RADIUS))
    return rows.where("one <> other").where(fits).select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``distinct``: node, size, fp, keys, doc_id, h (checkpointed).  Node and root of what has near copies."""
    masks = covering_masks()
    tables = F.transform(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks)]), lambda x: F.struct(x["t"].alias("t"), x["mask"].bitwiseAND(F.col("fp")).alias("key")))
    samples = F.transform("keys", lambda k: F.struct(F.lit(None).cast("int").alias("t"), k.alias("key")))
    keyed = distinct.where("size > 0").select("node", F.inline(F.concat(tables, samples)))
    bucket = F.xxhash64("t", "key").alias("bucket")
    keyed = keyed.select("node", "t", bucket)
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("shared")).where("shared > 1")
    held = cut(keyed.join(shared, "bucket"))
    popular = held.groupBy("node").agg(F.sum(F.floor(1000 * F.log("shared"))).alias("popular"))
    members = cut(popular.join(distinct.select("node", "size", "fp"), "node"))
    held = held.join(members, "node")
    centre = F.max(F.struct("popular", "node", "size", "fp")).alias("c")
    centres = cut(held.groupBy("bucket").agg(centre)).select("bucket", F.col("c.node").alias("other"), F.col("c.size").alias("m"), F.col("c.fp").alias("fq"))
    first = held.join(centres, "bucket").select(F.col("node").alias("one"), F.col("size").alias("n"), "fp", "other", "m", "fq", "t")
    first = cut(_pairs(first))
    folders: list[str] = []
    # buckets of two are settled by the first round
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(held.where("shared > 2").select("node")).distinct()
    sets = stored(sets_of(docs, wanted.join(distinct.select("node", "doc_id", "h"), "node")), "sets", folders)
    edges = cut(similar(first, sets))
    linked = stars(edges)
    rooted = held.where("shared > 2").join(linked.withColumnRenamed("a", "node"), "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted)
    # a bucket all of whose members are linked is done
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    left = cut(rooted.join(mixed, "bucket", "left_semi").select("node", "size", "root").distinct())
    more = cut(similar(prefix_pairs(left, sets, folders).join(first, ["a", "b"], "left_anti"), sets))
    discard(docs.sparkSession, folders)
    return linked if more.isEmpty() else stars(edges.unionByName(more))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id (the smallest doc_id)."""
    marked = cut(sketches(docs))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("_row")
    distinct = marked.groupBy("node").agg(least, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    distinct = cut(distinct.select("node", "size", "fp", "keys", "_row.doc_id", "_row.h"))
    linked = links(docs, distinct)
    members = linked.select(F.col("a").alias("node"), "root").unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    members = cut(members.join(distinct.select("node", "doc_id"), "node"))
    smallest = members.groupBy("root").agg(F.min("doc_id").alias("low"))
    named = members.join(smallest, "root").select("node", "low")
    # cut, so that both sides of the last join are plain exchanges and a hot node can be split
    named = cut(distinct.join(named, "node", "left").select("node", F.coalesce("low", "doc_id").alias("component_id")))
    return marked.select("doc_id", "node").join(named, "node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one that names it.

    Rows that share a doc_id are one document and leave one row; rows without doc_id cannot be told
    apart and stay.
    """
    named = components(docs).where("doc_id = component_id")
    kept = cut(named.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n")))
    here = F.col("doc_id").cast("long") == F.col("_kept")
    once = docs.join(kept.where("_n = 1"), here, "left_semi")  # about as many as documents: never a broadcast by hint
    out = once.unionByName(docs.where("doc_id IS NULL"))
    more = kept.where("_n > 1")
    return out if more.isEmpty() else out.unionByName(docs.join(small(more), here, "left_semi").dropDuplicates(["doc_id"]))
