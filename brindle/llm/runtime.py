"""Session-level helpers: shared storage for cut lineage and Arrow batch sizes."""

from __future__ import annotations

import atexit
import gc
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


_shipped: set[str] = set()
_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/brindle/{app}"
        atexit.register(_clear, spark, _folders[app])
    return _folders[app]


def _clear(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before; the folder stays
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    path = f"{_folder(spark)}/code/brindle.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound the Arrow batches by bytes as well as rows."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own; any
    other master is refused, since its executors could not read such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as compressed Parquet and read it back.

    Lineage ends there, so a lost executor costs at most the tasks it ran.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._brindle_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more.

    What was made from them must have been written itself.  The driver's garbage
    is collected too, so that Spark frees the shuffle files of finished jobs.
    """
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._brindle_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(written[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark then frees the shuffle files of finished jobs."""
    gc.collect()
    spark._jvm.System.gc()


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` of the rows with an id, as bigint and non-null string.

    Only these two columns are read, so further columns of any name do no harm.
    """
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` less the rows whose id is among ``gone``'s ``doc_id``; rows without an id stay."""
    key = fresh(docs, "gone")
    return docs.join(gone.select(F.col("doc_id").alias(key)), F.col(f"`{id_col}`").cast("bigint") == F.col(f"`{key}`"), "left_anti")
