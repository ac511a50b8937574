"""Session settings the operators count on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: AQE sizes and broadcasts from measured shuffle output, so no side is ever
#: broadcast on a guess; it also splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: Most bytes of a table that one scan task reads; bytes of input for which a shuffle starts with one partition more, and most bytes
#: that adaptive execution merges into one. Shuffled bytes are compressed: ids and short strings hold ten times as much in a sort.
SPLIT, PARTITION = 32 << 20, 16 << 20
_SPLIT, _INITIAL = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Whether shuffle files are deleted at the end of the execution that wrote them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Apply ``SETTINGS`` (runtime settings only) to a session.

    What one task holds must not grow with the tables: scans are cut into splits of ``SPLIT`` at most, and shuffles over a large
    ``folder`` start with as many partitions as its size asks for; adaptive execution merges those that turn out small, up to
    ``PARTITION`` bytes."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in ((_SPLIT, SPLIT), (_MERGED, PARTITION)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    parts = folder_bytes(spark, folder) // PARTITION if folder else 0
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_INITIAL, str(parts))
    else:
        spark.conf.unset(_INITIAL)
    return spark


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder, asked of the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("cardloom")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    A session on this machine only (``local[...]``) may go without the setting, as in tests; any
    other must name a folder that all its executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"{tempfile.gettempdir()}/cardloom-{spark.sparkContext.applicationId}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, unique subfolder of the shared folder; ``clear_staged`` deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


#: Folders made by ``fresh_folder`` in this process.
_STAGED: list[str] = []


def clear_staged(spark: SparkSession) -> int:
    """Delete the folders staged so far; frames that read them must not be used any more."""
    jvm, n = spark._jvm, 0
    conf = spark._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the file system that the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def stage(df, name: str = "stage"):
    """Write an intermediate result to the shared folder and read it back.

    Cuts a lineage that several branches share: it is computed once, survives the loss
    of executors, and gives the branches measured sizes to plan with. The shuffles of the write
    are read by nobody else, so their files go when it ends; else they lie until the driver collects its garbage."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
