"""What several operators share: tables in the shared folder, joins with hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()
#: A key is hot if it holds at least this share of the rows; so there are at most HOT_SHARE of them.
HOT_SHARE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or, where that is unset on one machine (tests), a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: executors of a cluster need a folder they share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, and safe when executors are lost.

    Such tables stay until forget, as results may still be read from them; one at a path of new_path may be removed before."""
    path = path or new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Removes every table that this application has written to the shared folder; for when their results are stored. How many."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table of written that nothing reads any more."""
    _WRITTEN.get(spark.sparkContext.applicationId, [path]).remove(path)
    delete(spark, path)


# Files, on whatever file system Spark reads from.


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202 - Java objects
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _file_system(spark, old)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"can't rename {old} to {new}")


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, bool, int]]:
    """(name, bytes, directory, time of change) of what is in a directory, by name."""
    fs, at = _file_system(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(at))


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a directory."""
    fs, at = _file_system(spark, path)
    return fs.getContentSummary(at).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file so that it is never half there: a draft first, then a rename over what there was."""
    draft = f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[-1]}.{uuid.uuid4().hex}.tmp"
    fs, at = _file_system(spark, draft)
    local = fs.getScheme() == "file"
    if local:
        fs = fs.getRawFileSystem()  # without files of checksums beside it
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if local:
        fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(path))
        return
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    context.rename(at, jvm.Path(path), options)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row per key and, in count, how many rows have it.

    Keys that hold 1/HOT_SHARE of all rows or more (so at most HOT_SHARE keys) go by broadcast, the others by a shuffle
    in which no key can be hot.
    """
    bar = max(10_000, -(-total // HOT_SHARE))
    hot, cold = table.where(F.col(count) >= bar), table.where(F.col(count) < bar)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, where they wouldn't find it by themselves."""
    root = Path(__file__).resolve().parent.parent
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in found:
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemill-")) / "tidemill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "tidemill").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


#: Settings (components, sources, specs) may be this many where tasks get all of them.
MAX_SETTINGS = 10_000


def bounded(settings: DataFrame, what: str, most: int = MAX_SETTINGS) -> DataFrame:
    """settings, to be sent to every task, after a count has shown that they are few; else an error."""
    if settings.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(settings)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a plain scan of less than half as many parts.

    For work that takes far longer than moving the rows. A part is at most spark.sql.files.maxPartitionBytes, so what is moved is
    at most half of that for each core, whatever the cluster; scans of more parts stay as they are. Rows are dealt by their
    number, so that no value of a column, null or repeated, can fill one part, and a repeated task deals them alike."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.toString().startswith("AdaptiveSparkPlan"):  # it has shuffles already
        return df
    return df.repartition(cores, F.monotonically_increasing_id()) if plan.execute().getNumPartitions() * 2 <= cores else df
