"""Resumable stages: configuration fingerprint, compute-if-absent tables with a content hash, report."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("prep", "scan", "search", "joint", "pairs", "verifier", "validate", "assemble")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's checkpoint folder; a temporary one only where there is one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessera-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder by columns and read again: cheaper than ``checkpoint`` if it is read often."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(folder)  # measurements seldom repeat
    return df.sparkSession.read.parquet(folder)


@dataclasses.dataclass(frozen=True)
class Config:
    """What a run's results depend on."""

    angle_step: float = 0.5
    sigma: float = 2.5
    radius: float = 10.0
    thresholds: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05, 0.1)
    lambdas: tuple[float, ...] = (0.0, 0.5, 2.0, 5.0)
    top: int = 30

    def errors(self) -> list[str]:
        """All that is wrong, not only the first."""
        out = [f"{n} must be positive" for n in ("angle_step", "sigma", "radius", "top") if not getattr(self, n) > 0]
        out += [f"{n} must not be empty" for n in ("thresholds", "lambdas") if not getattr(self, n)]
        return out + [f"lambda {x} is negative" for x in self.lambdas if x < 0]

    def fingerprint(self) -> str:
        """Ten digits of the SHA-1 of the canonical JSON; 2 and 2.0 are one value."""
        plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else float(v) if isinstance(v, (int, float)) else v
        values = {k: plain(v) for k, v in dataclasses.asdict(self).items()}
        return hashlib.sha1(json.dumps(values, sort_keys=True).encode()).hexdigest()[:10]


class Run:
    """A folder with one Parquet table a stage and a marker that holds the table's hash.

    The marker is written last, so an interrupted stage is computed again; paths go through Spark, so any
    store that Spark reaches will do.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config):
        if problems := config.errors():
            raise ValueError("; ".join(problems))
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{config.fingerprint()}"

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, stage: str) -> bool:
        fs, p = self._file(f"{self.folder}/{stage}.done/_SUCCESS")
        return fs.exists(p)

    @staticmethod
    def content(df: DataFrame) -> str:
        """Rows and an order-free sum of row hashes."""
        n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
        return f"{n}:{total}"

    def load(self, stage: str) -> DataFrame:
        """The stage's table, checked against its marker."""
        if not self.exists(stage):
            raise FileNotFoundError(f"stage {stage} has not been computed")
        df = self.spark.read.parquet(f"{self.folder}/{stage}")
        want = self.spark.read.json(f"{self.folder}/{stage}.done").first()["content"]
        if self.content(df) != want:
            raise ValueError(f"stage {stage} differs from its marker")
        return df

    def ensure(self, stage: str, compute: Callable[..., DataFrame], *needs: str) -> DataFrame:
        """Loads the stage or computes it from the stages it needs."""
        if self.exists(stage):
            return self.load(stage)
        compute(*[self.load(n) for n in needs]).write.mode("overwrite").parquet(f"{self.folder}/{stage}")
        content = self.content(self.spark.read.parquet(f"{self.folder}/{stage}"))
        self.spark.createDataFrame([(stage, content)], "stage string, content string").write.mode("overwrite").json(f"{self.folder}/{stage}.done")
        return self.load(stage)


def report(title: str, tables: Mapping[str, DataFrame], rows: int = 50) -> str:
    """Markdown of small result tables; each is limited to ``rows`` lines of display."""
    out = [f"# {title}"]
    for name, df in tables.items():
        shown = df.limit(rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in shown]
    return "\n".join(out) + "\n"


def report_json(title: str, tables: Mapping[str, DataFrame], accepted: bool | None = None, rows: int = 50) -> str:
    """The same as JSON with the verdict, keys in order, so that equal states give equal bytes."""
    shown = {name: [r.asDict(recursive=True) for r in df.limit(rows).collect()] for name, df in tables.items()}
    return json.dumps({"title": title, "accepted": accepted, "tables": shown}, sort_keys=True, default=str)
