"""op6_tput_topk: the five nearest vectors of every fiftieth vector by integer inner product."""

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import storage, topk_search


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.limit_arrow_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), storage.Workspace(spark, "topk"))


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
