"""op4_forest_secrets: candidates for secrets in all documents, and which of them the forest confirms."""

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import secrets, storage


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.limit_arrow_batches(spark)
    return secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), secrets.default_forest())
