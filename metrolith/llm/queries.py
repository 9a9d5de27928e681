"""The contract queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    langid,
    licenses,
    linededup,
    mixing,
    quality,
    secrets,
    simhash,
    tokens,
    toxicity,
)
from ._common import held_out
from .oracles import ORACLE_SQL  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op5_secrets(spark, sf_dir):
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_mixing(spark, sf_dir):
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = langid.languages(docs, langid.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_line_dedup(spark, sf_dir):
    return linededup.digest(_table(spark, sf_dir, "documents"))


def op9_token_output(spark, sf_dir):
    return tokens.encode_corpus(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op10_quality(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_simhash,
        op3_toxicity,
        op4_licenses,
        op5_secrets,
        op6_mixing,
        op7_language,
        op8_line_dedup,
        op9_token_output,
        op10_quality,
    )
}
