"""The corpus pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``; the last returns the mixture, one row per
copy. A text that a stage changes gets its new n_chars.

ORACLE_SQL is None: the stages rest on fitted models (language, secrets), on
similarity groups and on a bisected exponent, which SQL can't express; the
tests hold run() against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.llm import bagminhash, decontam, langid, mixing, secrets
from berth.llm.common import prepare
from berth.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, or without a letter) go; a missing lang
    is filled with the predicted one."""
    model = langid.train(docs)
    seen = langid.identify(docs.select(*COLUMNS), model)
    if not model["families"]:  # nothing to learn from: only wordless texts go
        return docs.select(*COLUMNS).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return seen.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return bagminhash.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs.select(*COLUMNS), benchmark, want_text=False).where("not contaminated").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked in the text; every document stays."""
    docs = docs.select(*COLUMNS)
    out = secrets.redact(docs, secrets.scan(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left: one row per copy, block and order key."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixture", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again in the
    shared folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
