"""The corpus pipeline: quality, near-duplicates, secrets, source mix and packing, each stage over all that the one before
it kept.  Every stage but the last returns the columns of its input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import line_quality, line_quality_query, mixing, near_dup, packing, secrets, storage

#: A document goes if its quality score is below this.
LEAST_QUALITY = 0.5
#: Share of the tokens that mixing keeps.
SHARE = 0.8


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while any(c.startswith(f"_{name}") for c in taken):
        name = f"_{name}"
    return f"_{name}"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line CRF rejects.

    Null and empty texts count as one blank line and are scored like any other; long texts are read whole; repeated rows
    stay or go together; an empty table stays empty; columns may have any names.
    """
    crf = line_quality_query.fitted(spark, docs, sf_dir)
    own = unused(docs, "quality_score")
    return line_quality.score(docs, crf, docs.columns, score_col=own).where(F.col(own) >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five words, similarity 0.8): that of the smallest id.

    Documents without words are alike to none and stay.  A null id is kept only where its group has no other, one text of
    the group then staying.  Of rows with equal id and text one stays, the first by a hash of all columns; only these meet
    in a shuffle of texts.  Long texts are read whole; an empty table stays empty.
    """
    storage.limit_arrow_batches(spark)
    groups = near_dup.near_duplicates(docs, storage.Workspace(spark, "pipeline-near-dup"))
    key, its, copies, named = (unused(docs, c) for c in ("mark", "its_mark", "copies", "its_id"))
    kept = groups.where("kept").groupBy(F.col("mark").alias(its), F.col("doc_id").alias(named)).agg(F.count("*").alias(copies))
    marked = docs.withColumn(key, near_dup.mark(F.col("doc_id"), F.col("text")))
    marked = marked.join(kept, (F.col(key) == F.col(its)) & F.col("doc_id").eqNullSafe(F.col(named)))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    repeated = marked.where(F.col(copies) > 1).withColumn(copies, turn).where(F.col(copies) == 1)
    return marked.where(F.col(copies) == 1).select(*docs.columns).union(repeated.select(*docs.columns))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows.  Every row stays: null and empty texts as they are, long ones read whole,
    repeated ones alike."""
    storage.limit_arrow_batches(spark)
    found = secrets.redact(docs, secrets.default_forest())
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their calibrated rates, SHARE of all tokens in expectation.

    Null sources and languages are sources and languages of their own; null and empty texts hold no tokens and are sampled
    at their cell's rate; rows of one id are sampled together; an empty table stays empty; columns may have any names.
    """
    prefix = unused(docs, "mix") + "_"
    found = mixing.sample(docs, storage.Workspace(spark, "pipeline-mixing"), share=SHARE, prefix=prefix)
    return found.where(F.col(f"{prefix}sampled")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens.  Null and empty texts hold their end alone; long ones are cut into
    full windows; repeated rows are packed as often as they occur; an empty table gives no pieces."""
    storage.limit_arrow_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("line_quality", quality), ("near_dup", one_of_each), ("secrets", redacted), ("mixing", mixed), ("packing", packed)]

#: No SQL expresses a trained model's decisions; tests/llm holds the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result stored and read again by the next."""
    space = storage.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = space.save(docs, name)
    return docs
