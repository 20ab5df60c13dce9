"""The queries of this subpackage, one for each operator, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.apply(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    out = suffix_dedup.deduplicate(read(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = read(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.sample_texts(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_levels

    return substring_levels.deduplicate(read(spark, sf_dir, "documents"), window=50, digest=True).withColumnRenamed("kept_text", "kept_sha256")


def op6_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fixity

    pages = read(spark, sf_dir, "pages")
    found = fixity.records(pages)
    return fixity.audit(found, fixity.damaged(found), placement=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import site_classifier

    return site_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.links(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import positional_index

    found = positional_index.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = [r.kind for r in secret_scan.RULES if r.base]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def queries() -> dict:
    found = (op1_quality_rules, op2_suffix_dedup, op3_language_id, op4_packing, op5_substring_dedup, op6_fixity_audit, op7_quality_classifier, op8_jaccard_join, op9_decontamination, op10_secret_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
