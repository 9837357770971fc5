"""Tables in the folder that driver and executors share, used to cut lineage and to reuse costly steps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch between Spark and a Python worker: texts may be long, so rows alone do not bound it.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


#: Applications that have the package's code.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package's code, once for an application.

    It also bounds the batches of rows that the session sends to Python, where that is not set: this holds for all that runs in the session.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # it runs from an archive that the session has already
        return
    name = Path(tempfile.mkdtemp(prefix="spark-")) / "paneltide.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(name))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a single machine, where that is unset, a fresh temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    ship(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: short lineage that any executor can recover from."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete a table of save() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False)) if isinstance(doc_id, str) else F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
