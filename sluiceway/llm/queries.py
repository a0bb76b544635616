"""Registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import chat, decontam, filter_audit, html_extract, licenses, mixing, ngram_join, quality, sharding, simhash, spelling, token_counts, token_store
from sluiceway.llm import sql as sql_text
from sluiceway.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = quality.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *[F.col(f"stats.{c}") for c in base], "base_failed", "kept", F.round("posterior", 4).alias("quality_prob"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluiceway.llm.common import words

    sized = table(spark, sf_dir, "documents").select("source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mixing.source_targets(sized)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text gets a head, a tag with its language in the middle, in place of up to five code points, and an end."""
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, drop, insert: F.struct(at.cast("int").alias("at"), drop.cast("int").alias("drop"), insert.alias("insert"))
    middle = F.least(size - F.floor(size / 2), F.lit(5))
    edits = F.array(edit(F.lit(0), F.lit(0), F.lit("# ")), edit(F.floor(size / 2), middle, F.concat(F.lit(" ["), F.coalesce("lang", F.lit("")), F.lit("] "))), edit(size, F.lit(0), F.lit("\nEnd.")))
    return token_counts.recount(docs.withColumn("edits", edits), keep=False)


def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents")).drop("ids")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.default_known(spark))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mix_sources, op3_chat_format, op4_decontaminate, op5_rendezvous_shards, op6_ngram_join, op7_token_counts, op8_extract_html, op9_token_store, op10_license_scan, op11_spelling_variants, op12_simhash_near_dedup, op13_filter_audit, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql_text.quality_sql(), "op10_license_scan": sql_text.license_sql(), "op13_filter_audit": sql_text.filter_audit_sql(), "mix_targets": sql_text.mix_targets_sql()}
