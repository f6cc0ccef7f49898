"""The registered queries of the training-data operators: thin digests over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    op01_chat,
    op02_chosen_path,
    op03_cotraining,
    op04_patched_for,
    op05_fm_index,
    op06_differencing,
    op07_suffixes,
    op08_outliers,
    op09_mixing,
    op10_language,
    op11_fill_middle,
    op12_prefix_trie,
    op13_packaged_warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = op09_mixing.mixing_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_chat.rotated(table(spark, sf_dir, "conversations"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_chosen_path.classes(table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op03_cotraining.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("kept", F.col("good"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_patched_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_patched_for.tokens(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op05_fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return op05_fm_index.digest(found)


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op06_differencing.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_suffixes.digest(op07_suffixes.deduplicated(table(spark, sf_dir, "documents")))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op08_outliers.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_language.languages(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op11_fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = op11_fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12_prefix_trie.with_shared_openings(op12_prefix_trie.sequences(table(spark, sf_dir, "conversations")))
    nodes = op12_prefix_trie.trie(found)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_packaged_warc.archived(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_rotation,
        op2_chosen_path,
        op3_cotraining,
        op4_patched_for,
        op5_fm_index,
        op6_page_differencing,
        op7_repeated_strings,
        op8_quality_outliers,
        op9_mix_sources,
        op10_rank_order_language,
        op11_fill_in_middle,
        op12_conversation_trie,
        op13_zip_warc,
        pipeline,
    )
}
