"""Fill-in-middle transformation on ropes.

A text is a rope (``rope``).  It is split at two unit ranks into prefix, middle and suffix; the output joins these
subtrees in another order with sentinel leaves between them, and restoring splits the tree of the output at its sentinels
and joins the parts in the old order.  Cuts and form of a document depend on its doc_id alone (numbers
of the hash of ``1:doc_id``), so reruns and lost executors change nothing; each document is one row in, one row out, no
exchange.

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;  spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* plain: the text as it is; all texts that are empty or hold a sentinel, and a tenth of the others.

A sentinel never arises across a border, because none begins as another ends, so the first of each in an output is the one
that was put there.

Defined results: a null text is empty; the number of a null doc_id is the empty string; repeated rows get equal results; an empty table gives no rows;
other columns are not read.  Texts of any length are handled; a task holds one batch of texts, and one tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import rope
from tessera.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that change, and of those the share that begins with the suffix.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1
#: Texts that are transformed before a batch is sent on.
_ROWS = 256


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers that choose cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, chosen: list[int], unit: re.Pattern | None = None) -> tuple:
    """Units, form, code points of prefix and middle (None if plain) and the rope of the output."""
    tree = rope.build(text, unit)
    n = tree.units if tree else 0
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or chosen[2] % 100 >= CHANGED:
        return n, "plain", None, None, tree
    low, high = sorted(h % (n + 1) for h in chosen[:2])
    head, suffix = rope.split(tree, high, unit=unit)
    prefix, middle = rope.split(head, low, unit=unit)
    p, s, m = (rope.Leaf(x, 1) for x in (PREFIX, SUFFIX, MIDDLE))
    form = "spm" if chosen[3] % 100 < SUFFIX_FIRST else "psm"
    out = None
    for part in (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle):
        out = rope.join(out, part)
    return n, form, prefix.points if prefix else 0, middle.points if middle else 0, out


def restore(output: str, form: str) -> str:
    """The text from which ``output`` was made: its tree split at the sentinels, joined in the old order."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    places = [output.index(first), output.index(second), output.index(MIDDLE)]
    rest, parts = rope.build(output), []
    for at, sentinel in zip(reversed(places), (MIDDLE, second, first)):
        rest, part = rope.split(rest, at, "points")
        parts.append(rope.split(part, len(sentinel), "points")[1])
    middle, later, earlier = parts
    prefix, suffix = (later, earlier) if form == "spm" else (earlier, later)
    return "".join(rope.pieces(rope.join(rope.join(prefix, middle), suffix)))


def transformed(docs: DataFrame, unit: str | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output (the new text); ``unit``: a pattern, by default code points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [transform(t.as_py() or "", numbers(d.as_py(), seed), pattern) for d, t in zip(part.column(0), part.column(1))]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                output = pa.array(["".join(rope.pieces(r[4])) for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (output, form and any others) with ``text``, rebuilt from those two alone."""
    at = [outputs.columns.index(c) for c in ("output", "form")]
    names = [*outputs.columns, "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = [restore(o.as_py(), f.as_py()) for o, f in zip(*(part.column(i) for i in at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return outputs.mapInArrow(run, outputs.schema.simpleString()[len("struct<") : -1] + ",text:string")


def op13_middle_ropes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restored(transformed(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
