"""op9_licence_scan: licences in all documents."""

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import licences


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licences.scan(docs).drop("text")


_VALUES = ",\n  ".join(
    f"({n}, '{t.licence}', {len(t.bigrams)}, {t.least}, {t.gap}, {t.run}, {t.longest}, [{', '.join(repr(b) for b in t.bigrams)}])" for n, t in enumerate(licences.templates())
)

ORACLE_SQL = rf"""
WITH template(t, licence, b, least, gap, run, longest, bigrams) AS (VALUES
  {_VALUES}),
known AS (SELECT t, unnest(bigrams) AS g FROM template),
word AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
doc AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM word),
place AS (SELECT doc_id, unnest(range(0, len(grams))) AS p, unnest(grams) AS g FROM doc WHERE len(grams) > 0),
hit AS (SELECT doc_id, t, p, g FROM place JOIN known USING (g)),
enough AS (SELECT doc_id, t FROM hit JOIN template USING (t) GROUP BY doc_id, t, least HAVING count(*) >= least),
step AS (
  SELECT doc_id, t, p, g, CASE WHEN p - lag(p) OVER w <= gap THEN 0 ELSE 1 END AS opens
  FROM hit JOIN enough USING (doc_id, t) JOIN template USING (t) WINDOW w AS (PARTITION BY doc_id, t ORDER BY p)),
run AS (SELECT doc_id, t, p, g, sum(opens) OVER (PARTITION BY doc_id, t ORDER BY p) AS n FROM step),
solid AS (SELECT doc_id, t, min(p) AS lo, max(p) AS hi FROM run JOIN template USING (t) GROUP BY doc_id, t, n, run HAVING count(*) >= run),
span AS (
  SELECT x.doc_id, x.t, x.lo, y.hi FROM solid x JOIN solid y ON x.doc_id = y.doc_id AND x.t = y.t AND y.lo >= x.lo JOIN template ON template.t = x.t
  WHERE y.hi - x.lo + 1 <= longest),
common AS (
  SELECT doc_id, t, lo, hi, count(DISTINCT g) AS c, count(*) AS n FROM span JOIN run USING (doc_id, t) WHERE p BETWEEN lo AND hi GROUP BY doc_id, t, lo, hi),
score AS (
  SELECT doc_id, licence, lo, hi, t, 2.0::DOUBLE * c / (len(list_distinct(grams[lo + 1 : hi + 1])) + b) AS dice
  FROM common JOIN template USING (t) JOIN doc USING (doc_id) WHERE n >= least),
best AS (
  SELECT * FROM score WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY dice DESC, lo, hi DESC) = 1),
top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, lo, licence DESC, hi DESC) = 1),
names AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, licence, dice, lo::INTEGER AS licence_place, (hi - lo + 1)::INTEGER AS licence_bigrams
FROM doc LEFT JOIN names USING (doc_id) LEFT JOIN top USING (doc_id)
"""
