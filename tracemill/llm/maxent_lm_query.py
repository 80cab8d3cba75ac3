"""op10_maxent_lm: log10 probabilities of all documents, learned from those outside the held-out fold."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import maxent_lm, storage


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.limit_arrow_batches(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out.alias("held_out"))
    return maxent_lm.score(docs, docs.where("not held_out"), storage.Workspace(spark, "lm"), keep=("held_out",))
