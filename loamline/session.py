"""Session settings used by tests and the benchmark; a cluster brings its own."""

from pyspark.sql import SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session in UTC. Keys in conf use `__` for dots."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loamline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
