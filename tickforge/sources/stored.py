"""Tables written once and read by several branches of a job."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[str] = []
_TABLES: dict[str, str] = {}
_OWN: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session that is one process may go without:
    it gets a temporary folder, removed at exit. Any other master must name a shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tickforge-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared one; ``clear_scratch`` removes it."""
    folder = f"{shared_base(spark)}/{kind}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def scratch_table(spark: SparkSession, kind: str) -> tuple[str, str]:
    """The name of a fresh table and its folder; ``clear_scratch`` drops it with the folder."""
    folder = scratch_folder(spark, kind)
    _TABLES[folder] = f"tickforge_{folder.rsplit('-', 1)[1]}"
    return _TABLES[folder], folder


def clear_scratch(spark: SparkSession, *folders: str) -> None:
    """Delete the given folders, or all that ``scratch_folder`` has handed out so far. Frames read
    from them can't be computed any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders or tuple(_FOLDERS):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(folder)}")
        if folder in _FOLDERS:
            _FOLDERS.remove(folder)


def stored(df: DataFrame, kind: str = "bars") -> DataFrame:
    """Write ``df`` as a table and read it back.

    For inputs that several branches use with different columns and periods: each branch then
    prunes columns and pushes its period into its own scan instead of recomputing the input.
    The written table also survives lost executors.
    """
    folder = scratch_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``stored`` whose readers are all written."""
    for frame in frames:
        names = {file.rsplit("/", 2)[-2] for file in frame.inputFiles()}
        folders = [folder for folder in _FOLDERS if folder.rsplit("/", 1)[-1] in names]
        if folders:
            clear_scratch(frame.sparkSession, *folders)


def stored_by_symbol(bars: DataFrame, kind: str = "bars", buckets: int | None = None, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The same for bars whose readers all work by symbol: one file per bucket of symbols, sorted by time.

    Windows, aggregates and joins by symbol read the buckets as they are, so the bars are shuffled once, when they are
    written, however many branches a job has. ``buckets`` is the number of shuffle partitions by default. The
    folder is registered as a table of the session, which is how Spark gets to know the buckets."""
    spark = bars.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, folder = scratch_table(spark, kind)
    by = list(dict.fromkeys((key, order)))
    (bars.repartition(n, key).sortWithinPartitions(*by).write.bucketBy(n, key).sortBy(*by)
     .format("parquet").option("path", folder).saveAsTable(name))
    return spark.table(name)


def write_documents(rows: DataFrame, folder: str, form: str = "json") -> None:
    """Response documents as nested JSON lines or Parquet, one per row."""
    if form not in ("json", "parquet"):
        raise ValueError(f"unknown form {form}")
    rows.write.mode("errorifexists").format(form).save(folder)
