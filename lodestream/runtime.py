"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the Python workers this package, once per application, wherever the driver has it from."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = Path(__file__).resolve().parent
        if here.is_dir():  # not so if the package itself was loaded from an archive
            archive = Path(tempfile.mkdtemp(prefix="lodestream-")) / "lodestream.zip"
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                for file in sorted(here.rglob("*.py")):
                    z.write(file, f"{here.name}/{file.relative_to(here)}")
            context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def session(app: str = "lodestream", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One parquet table of the data directory; Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all of Spark is on
    this machine (tests), and an error otherwise, since each executor would write to a disk of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="lodestream-")
        import shutil

        atexit.register(shutil.rmtree, _LOCAL_SHARED[app], True)
    return "file://" + _LOCAL_SHARED[app]


_STAGED: set[str] = set()


def stage_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it is removed when the driver ends, or by ``release``."""
    path = f"{shared_dir(spark)}/lodestream/{spark.sparkContext.applicationId}"
    if path not in _STAGED:
        _STAGED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context has ended before; the folder's owner clears it
        pass


def release(spark: SparkSession) -> None:
    """Removes the staged tables; for long sessions, after the results that read them have been written."""
    _remove(spark, stage_dir(spark))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a re-run, and lets several consumers
    share one evaluation. The table is columnar and compressed, so it is smaller than a checkpointed RDD.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
