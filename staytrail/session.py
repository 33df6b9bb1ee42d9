"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: settings every session of this library wants; UTC keeps timestamp
#: arithmetic identical across machines and engines.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "staytrail", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests use
    ``local[*]``.  A checkpoint directory is only set when the cluster did
    not name one.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the timezone must hold even when the session already existed
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the URI it was given.

    It is ``spark.checkpoint.dir``; only in local mode may that be unset, then a
    new temporary folder is used and set.  On a cluster a missing setting is an
    error, never a machine-local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="staytrail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point reliable checkpoints at the shared folder unless a folder is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark.sparkContext.getCheckpointDir()


#: scratch folders made by this process, by application id
_MADE: dict[str, list[str]] = {}
_ROOTS: set[str] = set()


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder under the shared one; it goes when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/staytrail-scratch/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        fs, p = _hadoop_path(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)  # only takes a path that exists
        _ROOTS.add(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the application's scratch folder; what is written there
    goes when the application ends, or before with ``drop_scratch`` or ``scratch_scope``."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Delete this application's scratch folders, all but the first ``keep``; no
    DataFrame that reads them may be used afterwards.  Returns their number."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = made[keep:]
    for path in gone:
        fs, p = _hadoop_path(spark, path)
        fs.delete(p, True)
    del made[keep:]
    return len(gone)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Within the scope stage tables may be made and read; at its end those made in it are deleted."""
    before = len(_MADE.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_scratch(spark, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once and cut its lineage: write it as a Parquet table in
    the shared folder and read it back (one job; survives executor loss; later
    reads get column pruning and filter pushdown).  Never a local checkpoint or
    a machine-local folder on a cluster.  Use for a stage that feeds several
    consumers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """``materialize`` as a table of ``parts`` buckets by ``key``: steps by the key that read it back need no exchange.

    ``df`` should lie by ``key`` in ``parts`` parts, so that each is one file.  The catalog entry that
    Spark asks for goes at once, the files stay as those of any stage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(parts, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: nothing is deleted
    return out
