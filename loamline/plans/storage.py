"""Cutting lineage by tables in the folder that all executors share."""

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one for a local session that names none.

    A cluster without the setting is refused: a machine-local folder would lose tables with its executor.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loamline-{uuid.uuid4().hex[:12]}/{name}"


def cut(df: DataFrame, name: str, by: str | None = None, placed: bool = False) -> DataFrame:
    """Write df once and go on from the written table, so that nothing behind it runs again.

    by: a column whose values become folders, so that a reader of some of them opens no others. placed: the rows of a
    value lie in one task already.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    w = (df.repartition(by) if by and not placed else df).write.option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by cut(); call it only when no later plan reads them."""
    spark = df.sparkSession
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(hadoop).delete(path, False)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, as --py-files would, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_loamline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    path = new_path(spark, "loamline.zip")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._loamline_shipped = True
