"""A corpus pipeline: language ID, near-dedup, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of ``documents``; the last returns packed pieces.
Each is written as Parquet and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syntarel.llm import language_id, mixing, near_dedup, packing, repeats
from syntarel.llm.common import cleared, delete_path, materialize, new_path

#: A document stays if its main language makes up this much of it.
LEAST_LANGUAGE = 0.55
#: Words of a passage that must not be found twice, however few bytes they take.
PASSAGE_WORDS = 51
#: Part of the tokens that mixing keeps.
KEEP = 0.8


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language stands out.

    The model learns from all rows with a language. Where there are none, every
    document with a letter stays. Null texts go.
    """
    model = language_id.train_language_model(docs)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.detect_language(docs, model, into="__language")
    return found.where((F.col("__language.lang_pred") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_LANGUAGE)).drop("__language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five words, 0.8): the one with the smallest id.

    Rows of one id are one document: each of its different texts stays. Rows without
    an id are documents known by their texts, near copies included; of a repeated one, one row stays.
    """
    found = materialize(near_dedup.near_classes(docs), "groups")
    heads = found.where("document = first").select(F.col("document").alias("__document")).distinct()
    keyed = docs.withColumn("__document", near_dedup.document_of())
    kept = keyed.join(heads, "__document", "left_semi").select(*docs.columns)
    if found.groupBy("document").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of a 400-byte string, and of a sequence of 51 words, found twice; characters cut in two go, and so do documents left blank.

    ``n_chars`` becomes the new length. Documents without repeats stay as they are.
    """
    cut = repeats.cut_repeats(docs, into="__repeats", words=PASSAGE_WORDS)
    changed = (F.col("__repeats.n_removed") > 0) | (F.size("__repeats.passage_spans") > 0)
    out = cut.withColumn("__changed", changed)
    out = out.withColumns({"text": F.col("__repeats.text"), "n_chars": F.when(F.col("__changed"), F.length("__repeats.text").cast("long")).otherwise(F.col("n_chars"))})
    return out.where(~F.col("__changed") | F.col("text").rlike(r"\S")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the tempered shares of sources, languages and topics."""
    mixed = mixing.mix(docs, keep=KEEP, into="__mixing")
    return mixed.where("__mixing.taken").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens: a row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, clustering and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's own tables go once it is written, its input with the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with cleared(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
