"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigurationError

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context: Python functions name it and it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    here = Path(__file__).parent
    made = Path(tempfile.mkdtemp(prefix="sparkloom-code-")) / "sparkloom.zip"  # the driver serves it, executors fetch it
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(str(made))
    sc._sparkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names.

    Where it is unset, a local session, as in tests, gets a temporary one; on a cluster that is an error, since no
    folder of one machine is seen by all.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkloom-")
        sc.setCheckpointDir(named)
    return named


def cut_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; it is removed when the application ends."""
    sc = spark.sparkContext
    at = f"{shared_folder(spark)}/sparkloom/{sc.applicationId}"
    if getattr(sc, "_sparkloom_cuts", None) != at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._sparkloom_cuts = at
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table survives the loss of executors, its plan is a bare scan (a checkpointed plan would keep the constraints
    of all it came from, which grow with every round of an iteration) and its size is known to the optimizer.
    """
    at = f"{cut_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget_cuts(spark: SparkSession) -> None:
    """Remove what ``cut_lineage`` has written, once no DataFrame that reads it is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cut_folder(spark))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    fs.mkdirs(at)


def partitions(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Deal rows out over the cores before a CPU-bound Python stage, only if the scan has too few partitions."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions(df) >= cores:
        return df
    return df.repartition(cores * per_core, *[F.col(k) for k in keys])
