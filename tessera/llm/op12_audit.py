"""What each filter removes under every order of the filters, by direct relational replay.

Each document's flags (does it fail filter A to E) are crossed with the 120 orders, a table of 120 rows that is
broadcast; the five steps of an order are exploded, the first failed step decides where the document goes,
and conditional sums a (part, order, step) count.  The sums are combined in each task before the one exchange, so a task sends
at most 600 rows a part, whatever it read, and a hot source is no hot key.  Nothing is put in order or
gathered by document.  The work is 600 short rows a document; ``replay`` takes a weight column, so that a
caller whose flags repeat may combine them first.

Filters (a document that meets the condition fails):

* A: fewer than 50 words;  B: 100 * distinct words < 65 * words;  C: 100 * capital letters A-Z > 5 * code points;
* D: any of ``#$%&*|``;  E: the text equals that of any smaller doc_id.

Defined results: a null text is empty (all such texts are equal); a null source and an empty one are the part of the
empty string; a row without doc_id never fails E, and no text is a copy of it; rows of one doc_id are not copies of each other
and each counts; of several labels of a doc_id, one that says good (quality 1) or toxic (1) decides; a document
without label is neither; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, small, table

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_flags(text: Column) -> dict[str, Column]:
    """Filters that one text decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": n < FEWEST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * capitals > CAPITALS_PERCENT * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (does the document fail), good, toxic: one row a document."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    own = own.select("doc_id", "part", F.sha2("text", 256).alias("_same"), *(c.alias(f) for f, c in text_flags(F.col("text")).items()))
    own = cut(own)
    # only texts that occur more than once; partial sums meet a hot text, and the join of two plain exchanges can be split
    first = cut(own.groupBy("_same").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_same", "_first"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = cut(known.where("doc_id IS NOT NULL"))
    found = own.join(small(first), "_same", "left").join(small(known), "doc_id", "left")
    is_copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    marks = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    return found.select("part", *FILTERS[:-1], is_copy.alias("E"), *marks)


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order and, for each filter, at which step it stands: one row an order."""
    rows = [("".join(p), *(p.index(f) + 1 for f in filters)) for p in itertools.permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"_{f} int" for f in filters))


def replay(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of ``flagged`` (part, a boolean a filter, good, toxic, and optionally weight) at each step of each order."""
    never = len(filters) + 1
    weight = F.col("weight") if "weight" in flagged.columns else F.lit(1)
    crossed = flagged.withColumn("_failed", sum(F.col(f).cast("int") for f in filters)).crossJoin(F.broadcast(orders(flagged.sparkSession, filters)))
    first = F.least(*(F.when(F.col(f), F.col(f"_{f}")).otherwise(never) for f in filters))
    # the filter of step k is the letter there; whether the document fails it is looked up by the letter
    fails = F.array(*(F.coalesce(*(F.when(F.col(f"_{f}") == k, F.col(f)) for f in filters)) for k in range(1, never)))
    steps = crossed.select("part", "filter_order", "good", "toxic", "_failed", weight.alias("_w"), first.alias("_first"), F.posexplode(fails).alias("_at", "_fails"))
    step = F.col("_at") + 1
    count = lambda condition, name: F.sum(F.when(condition, F.col("_w")).otherwise(0)).cast("long").alias(name)
    here = F.col("_first") == step
    sums = steps.groupBy("part", "filter_order", step.alias("step")).agg(
        count(F.col("_first") > step, "kept"),
        count(here, "removed"),
        count(F.col("_fails") & (F.col("_first") < step), "redundant"),
        count(F.col("_fails") & (F.col("_failed") == 1), "unique_fails"),
        count(here & F.col("good"), "good_lost"),
        count(here & F.col("toxic"), "toxic_lost"),
    )
    # 120 rows a part and filter, however many documents there are
    alike = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.withColumn("shapley", F.sum("removed").over(alike))


def op12_filter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > first_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, a, b, c, d, e, good, toxic, count(*) AS n, a::INT + b::INT + c::INT + d::INT + e::INT AS failed FROM f GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT r.x || s.x || t.x || u.x || v.x AS filter_order FROM letter r, letter s, letter t, letter u, letter v
  WHERE len(list_distinct([r.x, s.x, t.x, u.x, v.x])) = 5
), s AS (
  SELECT p.*, filter_order, step, substr(filter_order, step, 1) AS letter,
         list_filter([1, 2, 3, 4, 5], lambda k: CASE substr(filter_order, k, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS hits
  FROM p, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), g AS (
  SELECT part, filter_order, step::INT AS step, letter,
         coalesce(sum(n) FILTER (WHERE coalesce(hits[1], 6) > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE hits[1] = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE list_contains(hits, step) AND hits[1] < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE list_contains(hits, step) AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE hits[1] = step AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE hits[1] = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
