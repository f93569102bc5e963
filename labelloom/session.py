"""Sessions, table loading and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs on one machine, a local folder
    is made and remembered.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"labelloom-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


#: Rows up to which a side of a join is broadcast; a row of the sides it is used for takes some hundred bytes.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which are counted; else as it is, to be joined by shuffle, with skewed keys split at run time."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_TABLES: dict[str, list[str]] = {}


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends, or before by ``release``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so its lineage is cut.

    The table survives the loss of any executor. See ``scratch`` for its end.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables of ``written`` once their results have been consumed; the number of tables."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files, at = _at(spark, path)
        files.delete(at, True)
    return len(paths)
