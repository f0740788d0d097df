"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"


def build_session(app: str = "stationflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the submit options decide the rest."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Every instant in this library is UTC; pin the session zone so casts agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names, for tables that cut lineage.

    Only a local session without that setting falls back to a folder of its own, as in tests.
    """
    base = spark.conf.get(SHARED_DIR_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_DIR_KEY} must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="stationflow-")
        spark.conf.set(SHARED_DIR_KEY, base)
    return f"{base.rstrip('/')}/stationflow/{purpose}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors once per application, as `--py-files` would.

    Only steps that run Python in their tasks need it.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="stationflow-")) / "stationflow.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by `keys` when a table offers fewer splits than there are cores.

    Only small inputs are moved; on a cluster a large table has more splits than cores already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
