"""Mixing sources to target weights by Pareto order sampling (native: DataFrame functions only).

Each source gets a target in words.  Inside a source every document has an expected number of copies
that is proportional to ``size ** length_exponent`` and stops at ``max_copies``; the whole part is
certain, the fraction is an inclusion probability.  Documents are ranked by random odds over inclusion
odds, and the sample is the head of that order whose words come nearest to what the whole copies leave
of the target: a fixed size in words, unequal probabilities.

Defined results: a null source is a source of its own, sorted last; null and empty texts have size 0
and take 0 words; an empty table gives no rows; other columns are ignored by name, so clashing ones do no harm.
Every random number is a hash of seed, doc_id and text, so reruns agree, and rows without id or of one id
are drawn apart; rows equal in id, source and text are numbered, and each number draws by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import buckets, cut, numbered, small, stored, table, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
LENGTH_EXPONENT = 0.25
SEED = "mix-1"
_TINY = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes``: one row a source (source, source_size).  Adds ``target``.

    Resharing the excess by weight until no source is above its cap ends where target = min(cap,
    level x weight); the level is found in one pass over the sources by rising cap per weight.  The
    two windows see one narrow row a source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("_w", pick).withColumn("_cap", F.col("source_size").cast("double") * max_copies)
    rising = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_rank")
    all_rows = Window.partitionBy()
    listed = (
        listed.withColumn("_before", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest"))
    )
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level")))).over(all_rows)
    level = F.coalesce(first["_level"], F.lit(float("inf")))
    return listed.select("source", "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Inner join in which the null source meets itself."""
    right = per_source.withColumnRenamed("source", "_source")
    return rows.join(right, F.expr("source <=> _source")).drop("_source")


def _class(size: Column) -> Column:
    return F.rint(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def _bits(text: Column) -> Column:
    """52 bits of MD5, so that other engines can compute them too."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _own_bits(docs: DataFrame, seed: str) -> Column:
    own = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    return _bits(F.concat(F.lit(seed + ":"), own, F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit("")))))


def _repeated(sized: DataFrame) -> DataFrame | None:
    """Sources and bits that several rows have."""
    found = cut(sized.groupBy(F.col("source").alias("_s"), F.col("_h").alias("_r")).count().where("count > 1").select("_s", "_r"))
    return None if found.isEmpty() else found


def _told_apart(rows: DataFrame, repeated: DataFrame | None, own: list[str]) -> DataFrame:
    """``rows`` (``own``, source, _h) with ``_h`` drawn anew, by number, where rows share it."""
    if repeated is None:
        return rows
    same = F.expr("source <=> _s AND _h = _r")
    few = small(repeated)
    again = stored(rows.join(few, same, "left_semi").withColumn("_id", F.monotonically_increasing_id()).withColumn("_g", F.xxhash64("source", "_h")), "repeated", [])
    again = numbered(again, "_g", ["_id"], "_t").withColumn("_h", _bits(F.concat(F.col("_h").cast("string"), F.lit(":"), F.col("_t").cast("string"))))
    return rows.join(few, same, "left_anti").select(*own, "source", "size", "_h").unionByName(again.select(*own, "source", "size", "_h"))


def _with_expectation(rows: DataFrame, max_copies: int, exponent: float) -> DataFrame:
    """Adds _whole, _f and _v: certain copies, inclusion probability, rank key in [0, 1) (2: never)."""
    copies = F.least(F.lit(float(max_copies)), F.col("_c") * F.pow(F.lit(2.0), _class(F.col("size")) * F.lit(exponent)))
    whole = F.floor(copies + _TINY)
    rest = copies - whole
    u = (F.col("_h").cast("double") + 0.5) / float(2**52)
    rows = rows.withColumn("_whole", whole.cast("long")).withColumn("_f", F.when(rest > _TINY, rest).otherwise(0.0)).withColumn("_u", u)
    q = F.col("_u") * (1 - F.col("_f")) / ((1 - F.col("_u")) * F.nullif(F.col("_f"), F.lit(0.0)))
    return rows.withColumn("_v", F.coalesce(q / (1 + q), F.lit(2.0)))


def plan(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, exponent: float = LENGTH_EXPONENT) -> tuple[DataFrame, int]:
    """What decides for every document, one row a source, and the number of rank buckets.

    ``sized``: source, size, _h (checkpointed; narrow).
    """
    classes = sized.groupBy("source", _class(F.col("size")).alias("_q")).agg(F.sum("size").alias("_s"), F.count("*").alias("_n"))
    classes = cut(classes)  # at most 63 rows a source
    targets = source_targets(classes.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, max_copies)
    m = F.pow(F.lit(2.0), F.col("_q") * F.lit(exponent))
    falling = Window.partitionBy("source").orderBy(F.desc("_q"))
    leveled = (
        _by_source(classes, targets).withColumn("_m", m)
        .withColumn("_full", F.coalesce(F.sum("_s").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
        .withColumn("_open", F.sum(F.col("_m") * F.col("_s")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_try", F.try_divide(F.col("target") - max_copies * F.col("_full"), F.col("_open")))
    )
    ok = F.col("_try") * F.col("_m") <= max_copies * (1 + 1e-12)
    c = F.coalesce(F.max(F.when(ok, F.struct("_q", "_try"))).over(Window.partitionBy("source"))["_try"], F.lit(0.0))
    leveled = leveled.withColumn("_c", F.greatest(c, F.lit(0.0)))
    certain = F.floor(F.least(F.lit(float(max_copies)), F.col("_c") * F.col("_m")) + _TINY)
    levels = cut(leveled.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_c").alias("_c"), F.sum(certain * F.col("_s")).alias("_sure")))
    levels = levels.withColumn("_left", F.greatest(F.col("target") - F.col("_sure"), F.lit(0.0))).drop("_sure")

    n_rows = classes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    nb = buckets(n_rows)
    keyed = _with_expectation(_by_source(sized, small(levels)), max_copies, exponent)
    keyed = keyed.where("_v < 1").withColumn("_b", F.floor(F.col("_v") * nb).cast("int"))
    run = Window.partitionBy("source").orderBy("_b")
    sums = keyed.groupBy("source", "_b").agg(F.sum("size").alias("_w"), F.first("_left").alias("_left"))
    sums = sums.withColumn("_start", F.sum("_w").over(run) - F.col("_w")).where(F.col("_start") <= F.col("_left"))
    crossing = sums.groupBy("source").agg(F.max(F.struct("_b", "_start")).alias("_x")).select("source", F.col("_x._b").alias("_cb"), F.col("_x._start").alias("_start"))
    crossing = cut(crossing)
    inside = _by_source(keyed, small(crossing)).where("_b = _cb")
    ordered = Window.partitionBy("source").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_end", F.col("_start") + F.sum("size").over(ordered))
    cuts = inside.where(F.col("_end") - F.col("size") / 2 <= F.col("_left")).groupBy("source").agg(F.max("_v").alias("_cut"))
    out = (
        levels.join(crossing.select(F.col("source").alias("_x"), "_cb"), F.expr("source <=> _x"), "left")
        .join(cuts.select(F.col("source").alias("_k"), "_cut"), F.expr("source <=> _k"), "left")
        .select("source", "source_size", "target", "_c", "_cb", "_cut")
    )
    return cut(out), nb


def decide(rows: DataFrame, planned: DataFrame, nb: int, max_copies: int = MAX_COPIES, exponent: float = LENGTH_EXPONENT) -> DataFrame:
    """``rows`` (source, size, _h, anything more) with source_size, target and copies; no shuffle of ``rows``."""
    rows = _by_source(rows, small(planned))
    rows = _with_expectation(rows, max_copies, exponent).withColumn("_b", F.floor(F.col("_v") * nb).cast("int"))
    drawn = (F.col("_v") < 1) & ((F.col("_b") < F.col("_cb")) | ((F.col("_b") == F.col("_cb")) & (F.col("_v") <= F.col("_cut"))))
    rows = rows.withColumn("copies", F.col("_whole") + F.coalesce(drawn, F.lit(False)).cast("long"))
    return rows.drop("_c", "_cb", "_cut", "_whole", "_f", "_u", "_v", "_b", "_h")


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _own_bits(docs, seed).alias("_h")))
    repeated = _repeated(sized)
    sized = sized if repeated is None else cut(_told_apart(sized, repeated, ["doc_id"]))
    planned, nb = plan(sized, weights, **options)
    return decide(sized, planned, nb, **options).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    sized = cut(docs.select("source", word_count(F.col("text")).alias("size"), _own_bits(docs, seed).alias("_h")))
    repeated = _repeated(sized)
    planned, nb = plan(sized if repeated is None else cut(_told_apart(sized, repeated, [])), weights, **options)
    own = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    rows = docs.select(own, docs["source"], word_count(docs["text"]).alias("size"), _own_bits(docs, seed).alias("_h"))
    chosen = decide(_told_apart(rows, repeated, ["_doc"]), planned, nb, **options).where("copies > 0")
    return chosen.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_doc.*")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS own FROM documents
), bits AS (
  SELECT *, CASE WHEN count(*) OVER same > 1 THEN ('0x' || substr(md5(own || ':' || (row_number() OVER same_rows - 1)), 1, 13))::BIGINT ELSE own END AS h
  FROM sized WINDOW same AS (PARTITION BY source, own), same_rows AS (PARTITION BY source, own ORDER BY size)
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r, sum(source_size) OVER ()::DOUBLE AS total FROM src
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(r % 3 + 1)::INT] AS w, 3 * source_size::DOUBLE AS cap FROM ranked
), tried AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), lev AS (
  SELECT level FROM tried WHERE level * w <= cap ORDER BY cap / w, r LIMIT 1
), tgt AS (
  SELECT t.source, t.source_size, least(t.cap, (SELECT level FROM lev) * t.w) AS target FROM tried t
), cls AS (
  SELECT source, round_even(log2(greatest(size, 1)::DOUBLE), 0)::INT AS q, sum(size)::DOUBLE AS s FROM sized GROUP BY ALL
), opened AS (
  SELECT c.*, t.source_size, t.target, pow(2.0::DOUBLE, q * 0.25::DOUBLE) AS m FROM cls c JOIN tgt t ON c.source IS NOT DISTINCT FROM t.source
), leveled AS (
  SELECT *, (target - 3 * coalesce(sum(s) OVER (PARTITION BY source ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(m * s) OVER (PARTITION BY source ORDER BY q DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS t FROM opened
), cs AS (
  SELECT source, any_value(source_size) AS source_size, any_value(target) AS target,
         greatest(coalesce(arg_max(t, q) FILTER (WHERE t * m <= 3 * (1 + 1e-12::DOUBLE)), 0), 0) AS c FROM leveled GROUP BY source
), sure AS (
  SELECT cs.source, cs.source_size, cs.target, cs.c, greatest(cs.target - sum(floor(least(3.0::DOUBLE, c * m) + 1e-9::DOUBLE) * s), 0) AS rest
  FROM cs JOIN opened o ON cs.source IS NOT DISTINCT FROM o.source GROUP BY cs.source, cs.source_size, cs.target, cs.c
), expected AS (
  SELECT z.doc_id, z.source, z.size, u.source_size, u.target, u.rest,
         least(3.0::DOUBLE, u.c * pow(2.0::DOUBLE, round_even(log2(greatest(size, 1)::DOUBLE), 0) * 0.25::DOUBLE)) AS e,
         (h::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM bits z JOIN sure u ON z.source IS NOT DISTINCT FROM u.source
), fractions AS (
  SELECT *, floor(e + 1e-9::DOUBLE)::BIGINT AS whole, CASE WHEN e - floor(e + 1e-9::DOUBLE) > 1e-9::DOUBLE THEN e - floor(e + 1e-9::DOUBLE) ELSE 0 END AS f FROM expected
), odds AS (
  SELECT *, u * (1 - f) / ((1 - u) * nullif(f, 0)) AS odds FROM fractions
), ordered AS (
  SELECT *, sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds ASC NULLS LAST) AS upto FROM odds
)
SELECT doc_id, source, size, source_size, target, whole + (odds IS NOT NULL AND upto - size / 2 <= rest)::BIGINT AS copies,
       (whole + (odds IS NOT NULL AND upto - size / 2 <= rest)::BIGINT) * size AS taken
FROM ordered
"""
