"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_CONF = "spark.checkpoint.dir"
_DROP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "orestrata", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is written for.

    On a cluster the caller brings its own session; nothing else in the package
    calls this function.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the executors run in this very process
    (tests, a laptop) is a local folder made; it is used for the rest of the
    session and removed at its end. On a cluster the setting is required.
    """
    configured = spark.conf.get(_SCRATCH_CONF, None) or spark.sparkContext.getConf().get(_SCRATCH_CONF)
    if not configured:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"{_SCRATCH_CONF} must name a folder that all executors share")
            known = "file://" + tempfile.mkdtemp(prefix="orestrata-")
            atexit.register(shutil.rmtree, known.removeprefix("file://"), ignore_errors=True)
        configured = known
        spark.conf.set(_SCRATCH_CONF, configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps the rows columnar, so later
    reads prune columns; a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(settled: DataFrame) -> None:
    """Delete what ``settle`` wrote; nothing may read it any more."""
    jvm = settled.sparkSession._jvm
    for folder in {os.path.dirname(f) for f in settled.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(settled.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are dropped as soon as it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_DROP_CONF, None)
    spark.conf.set(_DROP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_CONF)
        else:
            spark.conf.set(_DROP_CONF, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Planned bytes up to which a table of few files is dealt over all cores before heavy work.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt over the cores.

    One file of one row group would otherwise keep a whole cluster waiting for
    one task. Larger tables and tables of many files stay as they are, without
    a shuffle; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned > SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
