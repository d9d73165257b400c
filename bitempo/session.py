"""Session settings, table access and lineage cuts shared by every operator.

Nothing here keeps data on the driver.  Lineage is cut with Parquet tables in
the shared folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured row count is below this.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the settings results depend on: the UTC session zone and AQE."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    Read from the session.  Only a local master without the setting (as in
    tests) gets a folder of its own; a cluster without it is an error, since a
    machine-local folder is lost with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="bitempo-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        _delete(spark, path)


class Cut:
    """A table written to the shared folder, with ``drop`` to delete it early."""

    def __init__(self, df: DataFrame, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/bitempo-{uuid.uuid4().hex}"
        _written.append((self.spark, self.path))
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder and read back."""
    return Cut(df).df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, read no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to AQE."""
    return F.broadcast(df) if small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer tasks than there are cores.

    For work that costs far more than moving the rows.  A table of many files
    is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
