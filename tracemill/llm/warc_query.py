"""op1_warc_index: every page written to WARC archives and read back through their index."""

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import storage, warc


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.limit_arrow_batches(spark)
    found = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), storage.Workspace(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
digest AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body)) AS first FROM page),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS b
  FROM digest)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * substr(b, 5 * i + 1, 1)::INTEGER + 8 * substr(b, 5 * i + 2, 1)::INTEGER + 4 * substr(b, 5 * i + 3, 1)::INTEGER + 2 * substr(b, 5 * i + 4, 1)::INTEGER
      + substr(b, 5 * i + 5, 1)::INTEGER + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM bits
"""
