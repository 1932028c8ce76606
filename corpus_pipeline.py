"""A corpus made ready for training: five stages, each of which works on what the one before kept.

In every stage: null and empty texts have no words, so they are scored, linked with nothing,
uncontaminated, without secrets and without tokens; repeated rows are treated alike, but that of
equal texts with different ids one document stays; whole texts count, however long; a null doc_id
is kept by the stages that go by ids; an empty table gives an empty one; columns of any name
besides those of documents come through the filtering stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, common, decontam, minhash, quality, secrets


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, scores 0.7 or more; all of them where these labels hold one class or none, as nothing is learned then."""
    machine = quality.train(docs, common.table(spark, sf_dir, "labels"))
    if machine is None:
        return docs
    score = common.fresh("score", docs.columns)
    return quality.score_quality(docs, machine, out=score).where(F.col(score) >= 0.7).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % similarity of five-word shingles, the document of least doc_id."""
    return minhash.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.without_matches(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; n_chars follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids."""
    import public_tokenizers

    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("tokens", encode)]

#: No SQL expresses the fitted classifier or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
