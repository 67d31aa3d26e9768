"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concurrency, conversations, fingerprint, language_id, mixing, near_dedup, packing, quality_model, quality_rules, repeats, sharding, toxicity, url_filter
from .common import fold, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("ratio", 6).alias("ratio"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    mixed = mixing.mix(docs, columns=["doc_id", "source", "lang"])
    return mixed.select("doc_id", "source", "lang", "mixing.topic", "mixing.tokens", F.round("mixing.rate", 6).alias("rate"), "mixing.taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_classes(_table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ``text`` is what is left when repeated sequences of 51 words, of any length in bytes, go as well; the other columns know 400 bytes only.
    cut = repeats.cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=51)
    return cut.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"), "repeats.text")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard(_table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    version = store.version()
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train_language_model(docs.where(fold(3) != 1))
    held = docs.select("doc_id", "text", (fold(3) == 1).alias("held_out"))
    return language_id.detect_language(held, model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.score_quality(docs, keep=["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rules.select("doc_id", "rules.*").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (fold(5) == 0).alias("held_out"))
    model = quality_model.train_quality_model(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    scored = quality_model.score_documents(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    # The texts are shuffled once, with their signatures.
    pairs = fingerprint.with_next(docs, ["text"], {"signature": fingerprint.signature(F.col("text"))})
    after = pairs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text"))).drop("text", "next_text")
    both = fingerprint.fingerprint(after, "edited", "edited_signature").withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(F.col("signature")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        fingerprint.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (fold(5) == 0).alias("held_out"))
    model = toxicity.train_toxicity_model(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = concurrency.sale_spans(*(_table(spark, sf_dir, x) for x in ("sales", "sale_lines", "clients")), days=0)
    found = concurrency.open_spans(spans)
    return found.select(F.col("key").alias("nation_id"), "from_s", "to_s", "n_open", F.col("open_amount").alias("open_cents"), "high_open", "is_peak")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_order_minhash": op10_order_minhash,
    "op11_toxicity": op11_toxicity,
    "op12_peak_concurrency": op12_peak_concurrency,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op5_sharding": "select doc_id, lang, source, n_chars, sha256(text) as text_sha256 from documents",
    "op1_url_filter": url_filter.filter_sql(URL_RULES),
    "op2_mixing": mixing.mixing_sql(),
    "op3_near_dedup": near_dedup.classes_sql(4, 80),
    "op4_suffix_dedup": repeats.repeats_sql(),
    "op12_peak_concurrency": concurrency.open_sales_sql(),
    "op13_conversation_repair": conversations.repair_sql(),
}
