"""The registered queries of this package: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontamination, embedding_dedup, html_extraction, kneser_ney, language_id, license_scan, merkle, minhash_forest, mixing, periodic_runs, secret_scan, suffix_array, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract asks for shingles of four words."""
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("row", "first")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled as of good quality and not as toxic."""
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return kneser_ney.judge(table(spark, sf_dir, "documents"), trusted)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda s: s.kind != "entropy")

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secret_spans")).alias("spans"),
        count("entropy"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    learnt = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents.where(learnt))
    return language_id.identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of every second document, by checksum of its id, are given its text without line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0

    def leaf(text: Column) -> Column:
        return merkle.digest(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)

    claimed = F.when(tampered, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return merkle.verify(table(spark, sf_dir, "documents"), leaf(F.col("text")), claimed)


# The rules that the contract gives.
URL_RULES = (
    url_filter.Rule(url_filter.BLOCK, "net", "/"),
    url_filter.Rule(url_filter.ALLOW, "example.net", "/en/"),
    url_filter.Rule(url_filter.BLOCK, "example.com", "/de/"),
    url_filter.Rule(url_filter.ALLOW, "org", "/fr/"),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def cycled(text: Column, doc_id: Column) -> Column:
    """The text of every tenth document, by checksum of its id, with its words repeating from some word on; others as they are."""
    checksum = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(f"({mixing.WORD})"), F.lit(1))
    n, part = F.size(words), F.floor(checksum / 10)
    begin = (part % n).cast("int")
    period = (1 + F.floor((n - begin) / (3 + part % 8))).cast("int")
    times = F.ceil((n - begin) / period).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), times))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), begin), F.slice(cycle, F.lit(1), n - begin)), " ")
    return F.when((checksum % 10 == 0) & text.rlike(mixing.WORD), changed).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = periodic_runs.find_runs(documents.select("doc_id", cycled(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), listed.alias("listed"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_quality": op5_quality,
    "op6_html_extraction": op6_html_extraction,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mix": op8_source_mix,
    "op9_suffix_array": op9_suffix_array,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_filter": op12_url_filter,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op11_merkle_manifest": merkle.oracle_sql(),
    "op12_url_filter": url_filter.oracle_sql(URL_RULES),
}
