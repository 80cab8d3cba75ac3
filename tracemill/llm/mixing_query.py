"""op8_ipf_mixing: the sampling rate of every document after raking source, language and topic, and who is sampled."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import mixing, storage


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = mixing.sample(docs, storage.Workspace(spark, "mixing"))
    return found.select("doc_id", "topic", "tokens", F.round("rate", 6).alias("rate"), "sampled")


#: Rounds of the SQL: past where the operator's tolerance ends its own.
ROUNDS = 40


def _steps() -> str:
    """One common table expression a fitting step."""
    out, last = [], "start"
    for k in range(ROUNDS):
        for m in mixing.MARGINS:
            name = f"step_{k}_{m}"
            out.append(
                f"{name} AS (SELECT source, lang, topic, tokens, want_source, want_lang, want_topic, least(1.0, rate * coalesce(want_{m} / "
                f"nullif(sum(tokens * rate) OVER (PARTITION BY {m}), 0), 1.0)) AS rate FROM {last})"
            )
            last = name
    return ",\n".join(out) + f",\nfitted AS (SELECT * FROM {last})"


ORACLE_SQL = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(lower(coalesce(text, '')), 'licen') THEN 'legal'
      WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
cell AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM doc GROUP BY ALL),
{", ".join(f"p_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, 0.7) AS p FROM cell GROUP BY {m})" for m in mixing.MARGINS)},
start AS (
  SELECT cell.*, 0.5::DOUBLE AS rate,
    {", ".join(f"(SELECT sum(tokens) FROM cell) * 0.5::DOUBLE * (p_{m}.p / (SELECT sum(p) FROM p_{m})) AS want_{m}" for m in mixing.MARGINS)}
  FROM cell {" ".join(f"JOIN p_{m} USING ({m})" for m in mixing.MARGINS)}),
{_steps()}
SELECT doc_id, topic, doc.tokens, round(rate, 6) AS rate,
  list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(md5(doc_id::VARCHAR), i, 1)) - 1) * pow(16.0, 8 - i))) / 4294967296.0 < rate AS sampled
FROM doc JOIN fitted USING (source, lang, topic)
"""
