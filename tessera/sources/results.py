"""Result files: a CSV of four columns whose cells hold JSON, and its constraints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import rle
from tessera.operators import metrics
from tessera.plans.stages import ensure_checkpoint_dir

COLUMNS = ("sample_id", "invivo_instances", "exvivo_instances", "match_pairs")
SCHEMA = StructType([StructField(c, StringType()) for c in COLUMNS])
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings; the header must be exactly the four columns."""
    header = spark.read.options(**_CSV).csv(path).columns
    if tuple(header) != COLUMNS:
        raise ValueError(f"columns are {header}, not {list(COLUMNS)}")
    return spark.read.options(**_CSV).schema(SCHEMA).csv(path)


def sample_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a file that may be broken or missing: no rows rather than an error."""
    try:
        return spark.read.options(**_CSV, mode="DROPMALFORMED").csv(path).select("sample_id").where("sample_id IS NOT NULL")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNRESOLVED_COLUMN" in str(e):
            return spark.createDataFrame([], "sample_id string")
        raise


def instances(results: DataFrame) -> DataFrame:
    """sample_id, modality, idx (place in the JSON object, from 0), cell_id, rle."""
    out = None
    for modality in ("invivo", "exvivo"):
        # entries in the order of the text; a row carries its own entry and not the whole object
        entries = F.posexplode(F.from_json(f"{modality}_instances", "map<string,string>")).alias("idx", "cell_id", "rle")
        part = results.select("sample_id", entries).select("sample_id", F.lit(modality).alias("modality"), "idx", "cell_id", "rle")
        out = part if out is None else out.unionByName(part)
    return out


def pairs(results: DataFrame) -> DataFrame:
    """sample_id, iv_id, ex_id of every listed pair."""
    parsed = results.select("sample_id", F.explode(F.from_json("match_pairs", "array<array<string>>")).alias("p"))
    return parsed.select("sample_id", F.col("p")[0].alias("iv_id"), F.col("p")[1].alias("ex_id"))


def problems(results: DataFrame, sizes: DataFrame, expected: DataFrame) -> DataFrame:
    """Everything wrong with a result: sample_id, what, detail.  ``expected``: sample_id, pos."""
    cells, matched = instances(results), pairs(results)
    say = lambda t, what, *detail: t.select("sample_id", F.lit(what).alias("what"), F.concat_ws(" ", *detail).alias("detail"))
    twice = results.groupBy("sample_id").count().where("count > 1")
    out = say(rle.problems(cells, sizes), "mask", F.col("modality"), F.col("cell_id"), F.col("error"))
    for part in (
        say(metrics.one_to_one_errors(matched), "used twice", F.col("side"), F.col("id")), say(metrics.missing_ids(matched, cells), "no instance", F.col("modality"), F.col("cell_id")),
        say(twice, "listed twice"), say(expected.join(results, "sample_id", "left_anti"), "missing"), say(results.join(expected, "sample_id", "left_anti"), "unknown"),
    ):
        out = out.unionByName(part)
    return out


def assemble(expected: DataFrame, cells: DataFrame, matched: DataFrame) -> DataFrame:
    """The rows of a result in the order of ``expected``; samples without pairs get an empty list (O193)."""
    side = lambda m: cells.where(F.col("modality") == m).groupBy("sample_id").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("idx", "cell_id", "rle"))), lambda r: F.struct(r["cell_id"], r["rle"])))).alias(f"{m}_instances"))
    listed = matched.groupBy("sample_id").agg(F.to_json(F.array_sort(F.collect_list(F.array("iv_id", "ex_id")))).alias("match_pairs"))
    out = expected.join(side("invivo"), "sample_id", "left").join(side("exvivo"), "sample_id", "left").join(listed, "sample_id", "left")
    return out.select("pos", "sample_id", *[F.coalesce(c, F.lit(e)).alias(c) for c, e in zip(COLUMNS[1:], ("{}", "{}", "[]"))])


def write_results(rows: DataFrame, path: str, sizes: DataFrame) -> None:
    """Writes the rows (with ``pos``) as one CSV in order, if nothing is wrong with them; a result has a row a sample."""
    wrong = problems(rows.drop("pos"), sizes, rows.select("sample_id", "pos")).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in wrong))
    rows.repartition(1).sortWithinPartitions("pos").select(*COLUMNS).write.mode("overwrite").options(header="true", quote='"', escape='"', quoteAll="true").csv(path)


class Refused(RuntimeError):
    """A result was not published because a file that it must agree with has changed."""


def csv_lines(rows: DataFrame, columns) -> DataFrame:
    """One column of CSV lines with minimal quoting; null is the empty field."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    return rows.select(F.concat_ws(",", *quoted).alias("line"))


def write_exact(rows: DataFrame, path: str, sizes: DataFrame, manifest: DataFrame | None = None) -> str:
    """The result as one CSV file, byte for byte the same for the same rows (O12); its SHA-256.  Nothing is written if something
    is wrong.

    The rows are assembled once and kept; tasks render and write ranges of ``pos``, and the file system's streams put the
    parts one after the other behind the header, so that the driver holds a buffer and no row.  The file has its
    name only when it is whole.  With a ``manifest`` (``digests`` of side files, taken when the run began) these are hashed
    again before the name is given; if one has changed or is gone, the candidate is removed and ``Refused`` raised (O13, O204).
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    rows = rows.select("pos", *COLUMNS).checkpoint()
    wrong = problems(rows.drop("pos"), sizes, rows.select("sample_id", "pos")).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in wrong))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    target, part, parts = at(path), at(f"{path}.part"), at(f"{path}.parts-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        ordered = rows.repartitionByRange("pos").sortWithinPartitions("pos")
        csv_lines(ordered, COLUMNS).write.option("lineSep", "\r\n").text(parts.toString())
        digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
        out = jvm.java.security.DigestOutputStream(fs.create(part, True), digest)
        try:
            out.write(bytearray((",".join(COLUMNS) + "\r\n").encode()))
            for name in sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
                source = fs.open(at(name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
        finally:
            out.close()
        if manifest is not None and (changed := altered(spark, manifest)):
            raise Refused("changed since the run began: " + ", ".join(changed))
        fs.delete(target, False)
        if not fs.rename(part, target):
            raise OSError(f"cannot rename {part} to {path}")
    finally:
        fs.delete(parts, True)
        fs.delete(part, False)
    return bytes(b % 256 for b in digest.digest()).hex()


def altered(spark: SparkSession, manifest: DataFrame) -> list[str]:
    """Those files of ``manifest`` (path, sha256; side files, few) whose content is no longer the same, or that are gone."""
    known = {r.path: r.sha256 for r in manifest.collect()}
    at, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in known if at(p).getFileSystem(conf).exists(at(p))]
    now = {r.path: r.sha256 for r in digests(spark, there).collect()} if there else {}
    return sorted(p for p, digest in known.items() if now.get(p) != digest)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and SHA-256 of files that a run must not change (O13, O204)."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def differs(written: DataFrame, base: DataFrame, keep: list[str]) -> DataFrame:
    """Samples whose kept columns are not those of the base, null-safe."""
    same = F.lit(True)
    other = base.select("sample_id", *[F.col(c).alias(f"_{c}") for c in keep])
    for c in keep:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return written.join(other, "sample_id", "full").where(~same).select("sample_id")


def feature_records(points: DataFrame, truth: DataFrame, digits: int = 3) -> DataFrame:
    """One nested record a sample for JSON export, rounded."""
    of = lambda m: points.where(F.col("modality") == m).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))), lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))).alias(f"{m}_centers"))
    known = truth.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.array("iv_id", "ex_id"))).alias("truth_pairs"))
    return of("invivo").join(of("exvivo"), "sample_id", "full").join(known, "sample_id", "left")


def latest(*tables: DataFrame, key: str) -> DataFrame:
    """Rows of several tables, the later table winning a key (O148)."""
    out = None
    for rank, t in enumerate(tables):
        part = t.withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy(key).orderBy(F.desc("_rank"))
    return out.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_rank")
