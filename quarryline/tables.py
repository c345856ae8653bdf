"""Access to the driver tables by Spark's readers only."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path Spark can open is fine."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
