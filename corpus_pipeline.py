"""A corpus pipeline of five stages, each calling one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet in the shared folder and hands what it reads back to the next. ``documents`` columns: ``doc_id,
text, lang, source, n_chars``.

1. language: documents without a letter or without text go. The decoded language becomes the document's,
   also over another label, unless it is ambiguous: then a label stays, and a document without one is
   ``und``. Where no document has a label, nothing can be learned and the language stays null.
2. near duplicates: one document of each class stays.
3. decontamination: benchmark passages are cut out of the text.
4. secrets: finds are replaced by a mark.
5. tokens: every text is encoded and decoded again; ids and digests join the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelumen.llm import bpe, decontaminate, language_id, near_dups, secrets
from pagelumen.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codes = language_id.learn(docs)
    if not codes.languages:
        return docs.select(*COLUMNS).where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = language_id.identify(docs.select(*COLUMNS), codes)
    kept = found.where(F.col("lang_pred") != language_id.UND)
    decoded = F.when(~F.col("ambiguous"), F.col("lang_pred")).otherwise(F.coalesce("lang", F.lit(language_id.UND)))
    return kept.withColumn("lang", decoded).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_first(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.remove_passages(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact(docs.select(*COLUMNS)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: Learned models decide in three stages, which SQL can't express: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
