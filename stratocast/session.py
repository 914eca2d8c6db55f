"""Session construction and the shared scratch location."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app="stratocast", master=None, shuffle_partitions=None):
    """Session with the settings the operators assume (UTC, AQE, skew handling)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


_LOCAL = {}


def shared_dir(spark):
    """Folder every executor can reach, as named by the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without the
    setting gets a temporary folder, one per application; anywhere else a machine-local
    folder would be invisible to the other executors, so its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


_SCOPES = []


def scratch(spark, label):
    """A new, unused path below the shared folder, noted by the innermost open scope."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def intermediates(spark):
    """Whatever is written below the shared folder in this scope is removed at its end.

    For a job that commits its result elsewhere: inside, build and write; outside, no frame
    built inside may be read again. Yields the list of paths. A job that fails removes them
    too; what a lost driver leaves behind goes with the shared folder.
    """
    paths = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def commit(spark, make, path, mode="error"):
    """Write ``make()`` to ``path`` and remove the intermediate tables it needed."""
    with intermediates(spark):
        make().write.mode(mode).parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_removed(spark):
    """What a job that is started in this scope has shuffled is removed when the job ends.

    For steps that are written and read back; frames that run again would shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df, label):
    """Write a stage result below the shared folder and continue from the table.

    Cuts the plan, keeps columnar pruning, and survives lost executors.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
