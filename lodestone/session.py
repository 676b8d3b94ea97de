"""Session defaults, table access and the shared scratch folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings that the queries assume: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.master(master)
        .appName("lodestone")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir.

    Where a local session names none (tests), a local folder is set as the checkpoint folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not root:
        existing = context._jsc.sc().getCheckpointDir()
        root = existing.get() if existing.isDefined() else tempfile.mkdtemp(prefix="spark-lodestone-")
        if not existing.isDefined():
            context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def kept(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files of ``source``: built once for each state of them (names, sizes, times), then read again.

    It is written aside and moved into place when it is complete, so a lost job or a second builder leaves no half table. Such
    tables stay until they are deleted; ``release`` leaves them.
    """
    fs, path = _files(spark, source)
    found, listed = fs.listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        listed.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    state = hashlib.sha256("\n".join(sorted(listed)).encode()).hexdigest()[:16]
    target = f"{shared_root(spark)}/kept-{name}-{state}"
    own, done = _files(spark, f"{target}/_SUCCESS")
    if not own.exists(done):
        aside = scratch_dir(spark, name)
        build().write.mode("overwrite").parquet(aside)
        own.rename(_files(spark, aside)[1], _files(spark, target)[1])
    return spark.read.parquet(target)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session; to be called once the results that read them are stored."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, target = _files(spark, path)
        fs.delete(target, True)
    return len(paths)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: cuts the lineage and survives the loss of an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition ahead of a step in Python; a stated number, so that adaptive execution doesn't merge the partitions."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def parallel(df: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than half the cores (a few small files) is dealt to all cores; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-lodestone-")) / "lodestone_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
