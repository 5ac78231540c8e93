"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exactdiff.llm import bpe, centroids, fingerprint, language_id, licenses, mixing, nearest, ngram_join, oracle, packing, pii, quality, turns
from exactdiff.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrated(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.hilbert_pack(table(spark, sf_dir, "documents"), ids=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = ["range", "place"]  # names a row, as a doc_id need not
    chained = fingerprint.with_next(docs, place=True)
    new = fingerprint.edited(F.col("text"), F.col("next_text"))
    each = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("kind"), new.alias("text"), F.sha2(new, 256).alias("sha")))
    facts = ["doc_id", "hash", "next_id", "next_hash", "n_chars"]
    chained = chained.select(*own, "doc_id", F.xxhash64("text").alias("hash"), "next_id", F.xxhash64("next_text").alias("next_hash"), F.length("text").cast("long").alias("n_chars"), "text", "next_text")
    texts = chained.select(*own, *facts, F.explode(each).alias("x")).select(*own, *facts, "x.kind", "x.text", "x.sha")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))

    def again(some: DataFrame) -> DataFrame:
        """The texts and edited texts of some documents, found by id and hash without ordering all documents anew."""
        plain = fingerprint.semi(rows, some.where("kind = 0"), {"doc_id": "doc_id", "hash": "hash"}).select("text")
        pairs = some.where("kind = 1").select("doc_id", "hash", "next_id", "next_hash").distinct()
        first = fingerprint.semi(rows, pairs, {"doc_id": "doc_id", "hash": "hash"}).select("doc_id", "hash", "text").distinct().toDF("id1", "h1", "text")
        second = fingerprint.semi(rows, pairs, {"doc_id": "next_id", "hash": "next_hash"}).select("doc_id", "hash", "text").distinct().toDF("id2", "h2", "next_text")
        named = pairs.join(first, F.col("hash").eqNullSafe(F.col("h1")) & F.col("doc_id").eqNullSafe(F.col("id1"))).join(second, F.col("next_hash").eqNullSafe(F.col("h2")) & F.col("next_id").eqNullSafe(F.col("id2")))
        return plain.union(named.select(new.alias("text")))

    prints = fingerprint.fingerprints(texts, [*own, "kind"], kept=[*facts, "sha"], again=again)
    plain, changed = F.when(F.col("kind") == 0, F.col("fingerprint")), F.when(F.col("kind") == 1, F.col("fingerprint"))
    shown = prints.groupBy(*own).agg(*(F.max(x).alias(x) for x in facts), F.max("sha").alias("edited_sha256"), F.max(plain).alias("fingerprint"), F.max(changed).alias("edited_fingerprint"))
    after = shown.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("h")).agg(F.min("fingerprint").alias("next_fingerprint"))
    alike = lambda x: (F.col("fingerprint") == F.col(x)).cast("double")
    joined = shown.join(after, F.col("next_hash").eqNullSafe(F.col("h")) & F.col("next_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    predicted = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return predicted.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(turns.damage(table(spark, sf_dir, "conversations")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
