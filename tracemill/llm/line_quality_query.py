"""op3_crf_quality: the quality of every document, learned from the labelled ones outside the held-out fold."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import line_quality, storage


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> line_quality.Crf:
    storage.limit_arrow_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "quality")
    return line_quality.fit(docs, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = line_quality.score(docs, fitted(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
