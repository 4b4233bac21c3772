"""One query for each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, grades, langid, lines, near, packing, personal, phrases, prints, repeats, rules, simhash

#: The tokenizer file; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), TOKENIZER)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), TOKENIZER)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def quality_model(spark: SparkSession, sf_dir: str) -> grades.Model:
    sample = grades.rated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), grades.label_grade())
    return grades.fit(sample)


def op4_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.grade(_documents(spark, sf_dir), quality_model(spark, sf_dir))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_documents(spark, sf_dir))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_documents(spark, sf_dir))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.compare(_documents(spark, sf_dir))


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(_documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_documents(spark, sf_dir))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_documents(spark, sf_dir))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5_rules."""
    return op5_rules(spark, sf_dir).drop("kept", "distance")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8_fingerprints."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {"op1_packing": op1_packing, "op2_langid": op2_langid, "op3_bpe": op3_bpe, "op4_grades": op4_grades, "op5_rules": op5_rules, "op6_near": op6_near, "op7_lines": op7_lines, "op8_fingerprints": op8_fingerprints, "op9_personal": op9_personal, "op10_repeats": op10_repeats, "op11_codes": op11_codes, "op12_simhash": op12_simhash, "op13_phrases": op13_phrases, "rules_base": rules_base, "edited_texts": edited_texts}
ORACLES = {"op7_lines": lines.ORACLE, "op11_codes": codes.ORACLE, "op13_phrases": phrases.ORACLE, "rules_base": rules.ORACLE_BASE, "edited_texts": prints.ORACLE_EDITED}
