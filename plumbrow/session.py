"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP_BYTES = 8 << 20  # of stored tables
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own.

    Array libraries in the Python workers get one thread each: Spark runs a worker per core.
    """
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbrow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. A folder of our own is made only for a
    local master, where the driver and the executors are the same machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbrow-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored table.

    Used where a result is read several times and recomputing it would repeat model scoring
    or an iterative fit. The stored table outlives a lost executor, and later reads take
    only the columns they need. Files have small row groups, so that ``cut`` can read them in pieces. With ``release`` the shuffle
    files of the write go when it ends, and not when the driver happens to collect its garbage; nothing else should run beside it.
    """
    path = scratch_path(df.sparkSession, "table")
    conf = df.sparkSession.conf
    kept = conf.get(RELEASE) if release else None
    if release:
        conf.set(RELEASE, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        if release:
            conf.set(RELEASE, kept)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(stored: DataFrame) -> list[tuple]:
    """Hadoop's path of the folder of a stored table, with its file system."""
    sc = stored.sparkSession.sparkContext
    folders = sorted({os.path.dirname(unquote(f)) for f in stored.inputFiles()})
    if any(not os.path.basename(f).startswith("table-") for f in folders):
        raise ValueError("not a table that settle stored")
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    return [(p, p.getFileSystem(sc._jsc.hadoopConfiguration())) for p in paths]


def discard(stored: DataFrame) -> None:
    """Remove a table that ``settle`` stored, when nothing will read it again."""
    for path, store in _folders(stored):
        store.delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no table of the driver needs any more.

    It does so when the driver collects its garbage, which a large heap puts off while the files add up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(stored: DataFrame, parts: int) -> DataFrame:
    """A table that ``settle`` stored, read in ``parts`` pieces or more, without a shuffle.

    A session of its own holds the size of a piece, so that other reads keep theirs.
    """
    if parts <= stored.rdd.getNumPartitions():
        return stored
    folders = _folders(stored)
    size = sum(store.getContentSummary(path).getLength() for path, store in folders)
    finer = stored.sparkSession.newSession()
    finer.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, int(size / (1.5 * parts)))))  # pieces end with a row group
    finer.conf.set("spark.sql.files.openCostInBytes", "0")
    return finer.read.schema(stored.schema).parquet(*[path.toString() for path, _ in folders])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
