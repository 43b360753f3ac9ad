"""From raw documents to a training mix: five stages, each written and read again.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last adds what the
mix takes of each document. Null, empty and repeated rows, empty tables and extra columns go through every stage, as the
operators' docstrings state; columns that a stage works with are dropped again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontamination, language_id, minhash_forest, mixing, secret_scan
from tickframe.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text or letters go, and ambiguous ones whose own label says otherwise.

    A missing label is filled in. Without any labelled document nothing is known, and only texts without letters go.
    """
    model = language_id.train(docs)
    found = language_id.identify(docs, model)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    unclear = F.col("ambiguous") & F.coalesce(F.col("lang") != F.col("lang_pred"), F.lit(True))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~unclear)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its five-word shingles; documents without words stay."""
    return minhash_forest.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew where that changed the text."""
    found = secret_scan.find_secrets(docs, into="__spans")
    changed = F.size("__spans") > 0
    redacted = secret_scan.redact(found, spans="__spans")
    return redacted.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with ``size``, ``source_size``, ``target``, ``taken`` and ``epochs``."""
    carry = [c for c in docs.columns if c not in ("doc_id", "source", "size", "source_size", "target", "taken", "epochs")]
    return mixing.mix(docs, carry=carry).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

# The near-duplicate, alignment and learned stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
