"""Session helpers shared by every operator: table access and the shared folder."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "newsloom", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NEWSLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package() -> None:
    """Pickle this package's functions by value, so executors need no copy of it."""
    import newsloom

    cloudpickle.register_pickle_by_value(newsloom)


def shared_object(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast an object of this package's own classes; called in a task, the result gives the object.

    A plain broadcast would have the executors import the package; this carries the classes along.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="newsloom-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``discard_staged`` empties it."""
    return f"{shared_dir(spark)}/newsloom/{spark.sparkContext.applicationId}"


def discard_staged(spark: SparkSession) -> None:
    """Deletes what this application has written between steps. Results that read it must have been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(spark: SparkSession, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors do no harm."""
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select and rename only the named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])
