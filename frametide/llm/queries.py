"""The queries of this subpackage: op1 to op13, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, html, jaccard, language, packing, pieces, quality, rules, secrets, substring, warc, whitening
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.write(pages).read(pages.select("url"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_positions")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whitening.whiten(embeddings, whitening.fit(embeddings))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_rules that SQL can say, from the same operator."""
    return op3_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_secrets that SQL can say, from the same operator."""
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op12_whitening that SQL can say, from the same operator."""
    return op12_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


QUERIES = {f.__name__: f for f in (op1_quality, op2_substring, op3_rules, op4_html, op5_language, op6_jaccard, op7_packing, op8_secrets, op9_warc, op10_decontaminate, op11_sentencepiece, op12_whitening, op13_codes, rules_base, secrets_base, whitening_base)}
ORACLE_SQL = {"op2_substring": substring.ORACLE, "op6_jaccard": jaccard.ORACLE, "op9_warc": warc.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op13_codes": codes.ORACLE, "rules_base": rules.BASE_ORACLE, "secrets_base": secrets.BASE_ORACLE, "whitening_base": whitening.BASE_ORACLE}
