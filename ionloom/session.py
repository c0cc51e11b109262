"""Session helpers: a tuned local session, table loading, shared checkpoints."""

from __future__ import annotations

import os
import pickle
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Parquet tables are looked up as ``{dir}/{name}.parquet`` (a file or a folder).
TABLE = "{dir}/{name}.parquet"


def local_session(cpus: int | None = None, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the given one."""
    return (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName("ionloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test or production tables, with its own schema and statistics."""
    return spark.read.parquet(TABLE.format(dir=sf_dir, name=name))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that folder is
    always used.  Only where the setting is absent (tests, one machine) is a
    temporary folder taken, and only by a local session: the executors of a cluster
    could not read each other's files there.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ionloom-", dir=os.environ.get("TMPDIR", "/tmp")))


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For Python work that costs far more than moving its input: a table of one small file
    would run in one task.  Tables with enough splits are returned as they are.  ``source`` is the scanned
    table whose splits count, where ``df`` holds shuffles that counting would run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (df if source is None else source).rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    Used where a result is read more than once or an iteration would grow the
    plan; the files survive the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Shared:
    """A driver's value as a broadcast that workers load once per process.

    Its classes travel by value, so executors need no installed copy of the package.
    """

    def __init__(self, spark: SparkSession, value: object) -> None:
        data = cloudpickle.dumps(value)
        self.size = len(data)
        self._bytes = spark.sparkContext.broadcast(data)
        self._key = uuid.uuid4().hex

    @property
    def value(self):
        held = sys.__dict__.setdefault("_ionloom_shared", {})
        if self._key not in held:
            while len(held) >= 4:
                held.pop(next(iter(held)))
            held[self._key] = pickle.loads(self._bytes.value)
        return held[self._key]


def small_or_none(df: DataFrame, limit: int) -> int | None:
    """The row count if it is at most ``limit``, else None.  Reads at most limit+1 rows."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None
