"""The project's tables as DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone; the session's zone must be UTC."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
