"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.llm import (chat, decontaminate, html_extract, jaccard_join, langid, mixing, quality, rules, secrets,
                         simhash, token_align, token_files, turn_repair)
from keyroll.llm.common import read
from keyroll.llm.sql import ORACLES
from keyroll.session import apply_conf

# Rows of an Arrow batch: texts can be long, and a batch is held in a worker.
BATCH_ROWS = "500"

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def mix_domain():
    """Domain of a source: its number modulo 3 (a source without one: none)."""
    return F.concat(F.lit("d"), F.expr("try_cast(nullif(regexp_extract(source, '[0-9]+$', 0), '') as int) % 3").cast("string"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = read(spark, sf_dir, "labels").filter(F.col("quality").isNotNull() & (_fold(5) != 0))
    weights = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, weights).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.PREDICT).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter(_fold(3) != 1)
    return langid.predict(_documents(spark, sf_dir), langid.learn(learn)).select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_documents(spark, sf_dir)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir))).select(
        "row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mix = mixing.select_mix(docs, mix_domain(), F.expr(mixing.TOTAL), mixing.WEIGHTS, mixing.EPOCHS)
    return mix.select("row.doc_id", "epoch", "tokens", *mixing.LEVELS, "budget")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.main_text(pages, html_extract.learn(pages))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(_documents(spark, sf_dir), tokenizer_path()))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = _documents(spark, sf_dir), (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return token_align.with_counts(token_align.align(docs, *paths))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.counted(simhash.compare(_documents(spark, sf_dir)), F.col("doc_id") % 20 == 0)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audit(read(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_language_id, op3_quality_rules, op4_secret_scan, op5_source_mix, op6_chat_format,
    op7_html_text, op8_decontaminate, op9_jaccard_join, op10_token_files, op11_token_align, op12_simhash,
    op13_turn_repair)}


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on."""
    apply_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _pinned(fn: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _pinned(f) for k, f in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
