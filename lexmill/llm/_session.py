"""Settings, shared folders and written intermediate tables of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import getpass
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that Spark hands to Python, and the rows it may hold at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 200_000


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context: they may have neither the driver's folders nor its module path."""
    context = spark.sparkContext
    if getattr(context, "_lexmill", None):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(archive))
    context._lexmill = True


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts make small batches and short rows large ones."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/lexmill-{getpass.getuser()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders made so far, in order, and not deleted.
FOLDERS: list[str] = []


def run_dir(spark: SparkSession, what: str) -> str:
    """A new folder below shared_dir(); it is deleted by release(), or when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if not FOLDERS:
        atexit.register(release, spark)
    FOLDERS.append(path)
    return path


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders from number since of FOLDERS on, but for keep. What still reads them fails: call it when results are written."""
    for path in FOLDERS[since:]:
        if path not in keep:
            _delete(spark, path)
            FOLDERS.remove(path)
    _collect(spark)


def _collect(spark: SparkSession) -> None:
    """Shuffle files of what has been written go as soon as the driver's collectors find that no plan holds them."""
    gc.collect()
    with contextlib.suppress(Exception):  # the JVM may be gone already
        spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system for Python workers and the path in it, for the schemes that Spark knows: file, hdfs, s3a, gs, abfss, and
    those of fsspec where that is installed."""
    scheme, _, rest = path.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)
    except pa.ArrowInvalid:
        import fsspec

        store, root = fsspec.core.url_to_fs(path)
        return pafs.PyFileSystem(pafs.FSSpecHandler(store)), root


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: it is computed once, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = run_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() wrote and that nothing reads any more."""
    spark = tables[0].sparkSession
    for t in tables:
        if t._folder in FOLDERS:
            _delete(spark, t._folder)
            FOLDERS.remove(t._folder)
    _collect(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, and at its end freed memory goes back to the system: workers stay for later tasks, beside stages that run in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return run
