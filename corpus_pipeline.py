"""From documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, but for the last one, which
returns the packed pieces. A stage works on all that its predecessor kept.

* language_id: documents without a letter, or no shorter than noise under any learned language, go; a missing lang is
  filled with the predicted one.
* ngram_join: of documents that five-word shingles link at a similarity of 0.8 or more, directly or through others,
  the one with the smallest doc_id stays; so does every document without words, and every row without doc_id. Rows
  that share a doc_id stay or go together; of those that stay, equal texts stay once.
* pii: personal data, disguised or not, is replaced by its kind in square brackets; n_chars follows.
* mixing: documents are drawn with probabilities calibrated to the targets of source, language and topic.
* packing: what is left is cut into sequences of 4096 tokens along a space-filling curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exactdiff.llm import language_id, mixing, ngram_join, packing, pii
from exactdiff.llm.common import broadcast_if_small, cut, cut_narrow, small_batches, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = language_id.train(docs)
    kept = language_id.accepted(language_id.predict(docs, model), model)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = cut(ngram_join.join_components(docs, width=5, percent=80))
    stays = F.max(F.col("component_id").eqNullSafe(F.col("doc_id")))
    each = cut_narrow(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), stays.alias("stays")))
    kept = docs.join(broadcast_if_small(each.where("not stays").select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    again = each.where("n > 1 and stays").select("doc_id")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.hilbert_pack(docs)


STAGES = [("language_id", identify), ("ngram_join", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: SQL has no way to state the first, second, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
