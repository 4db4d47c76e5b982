"""Session defaults and the shared folder for lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "patchlore") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir`` or ``setCheckpointDir``.

    Only a session that runs in one process gets a temporary folder: on a
    cluster a machine-local path would lose the data together with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="patchlore-")
        root = _local_dirs[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/patchlore/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_cuts(spark: SparkSession) -> bool:
    """Delete what ``cut``, ``cut_by`` and the queries of this application have written, once nothing reads it any more."""
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/patchlore/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used between loop rounds and before a result that is read several times.
    Parquet keeps column pruning and statistics, and a lost executor re-reads
    files instead of replaying the rounds before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, by: Sequence[str], name: str = "cut") -> DataFrame:
    """``cut`` as a table bucketed by the columns ``by``, so that no join or group on them shuffles its rows again.

    For what many loop rounds join with. All rows of one value of ``by`` lie in one
    file, which one task reads: split hot values by a further column first.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = f"patchlore_{name}_{uuid.uuid4().hex}"
    whole = df.repartition(buckets, *by)
    whole.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *by).saveAsTable(table)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)
