"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", app: str = "sentline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per context, so that UDFs find it without an installation."""
    sc = spark.sparkContext
    if getattr(sc, "_sentline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sentline-")  # on the driver, from where it goes to the executors
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "sentline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("sentline", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._sentline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session (tests) may have one of its own. What this application
    puts there is deleted when it ends."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not path:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = os.path.join(tempfile.gettempdir(), "sentline-checkpoints")
        sc.setCheckpointDir(path)
    folder = sc._jsc.sc().getCheckpointDir().get()
    if getattr(sc, "_sentline_cleaned", None) != folder:
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
        sc._sentline_cleaned = folder
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, and later steps read only the
    columns that they use."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SMALL = 32 << 20  # bytes in memory up to which a table is broadcast
SPREAD_FROM = 512 << 10  # bytes of a scan from which it is worth moving its rows to use all cores


def measured_bytes(df: DataFrame) -> int:
    """Size of a table's rows as text, counted row by row; no estimate."""
    return int(df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"] or 0)


def is_small(df: DataFrame, limit_bytes: int = SMALL) -> bool:
    return measured_bytes(df) <= limit_bytes


def broadcast_if_small(df: DataFrame, limit_bytes: int = SMALL) -> DataFrame:
    """A broadcast hint if the rows themselves, not an estimate, are small; a larger table is joined by shuffle."""
    return F.broadcast(df) if is_small(df, limit_bytes) else df


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what a plan reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, from_bytes: int = 0) -> DataFrame:
    """Cut a scan of few files into as many partitions as there are cores, before work that costs far more than moving
    the rows. A scan that already has as many stays as it is, and so does one below a size."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n and scan_bytes(df) >= from_bytes else df
