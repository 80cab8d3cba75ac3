"""op5_bfd_packing: all documents packed into sequences of 2048 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import packing, storage


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.limit_arrow_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)
