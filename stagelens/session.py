"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here relies on: re-planning from real sizes, and
# splitting of skewed join partitions even where that costs one more exchange; the charsets of the Java
# runtime for files that are not in UTF-8, with what they cannot decode replaced.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}

# Where a local session without spark.checkpoint.dir keeps its tables; STAGELENS_SCRATCH names another folder.
LOCAL_SCRATCH = os.environ.get("STAGELENS_SCRATCH", os.path.join(tempfile.gettempdir(), "stagelens"))

# Written tables of each application that nobody asked to keep, oldest first.
_WRITTEN: dict[str, list[str]] = {}

# Names of the tables that are laid out by a column, by path.
_NAMES: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "stagelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {"spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session may go without it; it then uses LOCAL_SCRATCH.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the scratch folder."""
    return f"{scratch_dir(spark)}/stagelens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def temporary_path(spark: SparkSession, name: str) -> str:
    """A whole path, with its file system, for files that are not written by Spark; it goes with the ``step`` around it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:/"):  # other readers of such addresses want the empty host
        whole = "file:///" + whole.removeprefix("file:").lstrip("/")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(whole)
    return whole


def write_scratch(df: DataFrame, name: str, rebalance: bool = False, keep: bool = False) -> str:
    """Write below the scratch folder; ``rebalance`` evens out the files of a big table.

    A table that is not kept goes with the ``step`` it was written in.
    """
    if rebalance:
        df = df.hint("rebalance")
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if not keep:
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "table", rebalance: bool = False) -> DataFrame:
    """Write a frame once and read it back.

    Cuts the lineage, survives lost executors, prunes columns on later reads and
    gives the planner the true size, so it alone decides whether to broadcast.
    """
    path = write_scratch(df, name, rebalance)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_clustered(df: DataFrame, name: str, by: Sequence[str], keep: bool = False) -> str:
    """Write a table once, in as many buckets as there are shuffle partitions by the hash of ``by``; its name.

    Whatever groups by, joins on or opens windows over ``by`` (and more columns) needs no exchange from then on. A
    frame that comes from such tables is written where it is; any other one should be partitioned by ``by``
    (``clustered``), or every task writes a file per bucket.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"stagelens_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # each task reads its bucket and writes it again; else it would read pieces of all and write a file per bucket
    whole = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(whole)
    spark.conf.set(whole, "false")
    try:
        df.write.bucketBy(buckets, *by).option("path", path).format("parquet").saveAsTable(table)
    finally:
        spark.conf.set(whole, before)
    _NAMES[path] = table
    if not keep:
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return table


def clustered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows dealt by the hash of ``by``, as ``write_clustered`` lays them out."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Remove at its end the tables that were written inside and not kept.

    For a step whose result is written out inside: nothing reads them any more.
    """
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    first = len(written)
    try:
        yield
    finally:
        for path in written[first:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            if path in _NAMES:
                spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(path)}")
        del written[first:]
