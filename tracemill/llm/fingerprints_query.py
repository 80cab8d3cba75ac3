"""op7_winnowing: fingerprints of all documents, of their edited texts, and how alike they are."""

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import fingerprints


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
