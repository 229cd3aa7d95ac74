"""Session helpers: table access, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", name: str = "pulsegrid", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per session, so that they need neither an installation nor a search path."""
    sc = spark.sparkContext
    if getattr(sc, "_pulsegrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="pulsegrid-code-"))
    with zipfile.ZipFile(folder / "pulsegrid.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(folder / "pulsegrid.zip"))
    sc._pulsegrid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan, hashed by key over all cores if it has fewer splits than the cluster has cores.

    For work that costs far more than moving its rows; large tables have splits enough and stay where they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set here where a local session has none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(sc, "_pulsegrid_shared", None)
    if own is None:
        own = sc._pulsegrid_shared = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return own


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Unlike an in-memory copy it survives the loss of executors, and later scans prune columns. Give it to discard() once
    nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pulsegrid_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames from materialize(); other frames are left alone."""
    for df in frames:
        found = getattr(df, "_pulsegrid_path", None)
        if found:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def real(col):
    """NULL for NaN: both mean missing."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(col), None).otherwise(col)
