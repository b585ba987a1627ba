"""Queries over the test tables that apply the operators of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import SECRETS_SQL
from .urls import URLS_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out, m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col(f"{m}.size") * F.col(f"{m}.copies")
    return out.select("doc_id", f"{m}.size", f"{m}.source_size", f"{m}.target", taken.alias("taken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    out, m = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), f"{m}.lang_pred", f"{m}.score", f"{m}.ambiguous")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import LISTED_SITES, RULES, filter_urls

    rows = [(*r, 0) for r in RULES] + [(site, "", "block", 1) for site in LISTED_SITES]
    listed = spark.createDataFrame(rows, "host string, path string, verdict string, rank int")
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return out.select(
        "page.page_id", "host", "path", F.when(F.col("rank") == 0, F.col("entry")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rank") == 1, F.col("entry")).alias("listed"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents"))
    licenses = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.select("doc_id", F.size("matches").cast("bigint").alias("n_templates"), F.array_join(licenses, ",").alias("licenses"), F.array_max(F.transform("matches", lambda m: m["containment"])).alias("containment"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets, span_report

    return span_report(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), ["assign", "access", "hex"])


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_bytes

    out = shard_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, span_report

    return span_report(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")), KINDS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, m = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", f"{m}.n_words", f"{m}.n_hit", F.size(f"{m}.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{m}.items", ","), 256).alias("items_sha256"), (F.col(f"{m}.n_hit") > 0).alias("contaminated"),
        F.col(f"{m}.longest").alias("longest_match"), F.col(f"{m}.longest_at").alias("longest_match_at"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprint, op2_mix_sources, op3_language_id, op4_url_filter, op5_license_scan, op6_secret_scan, op7_shard_documents, op8_personal_data, op9_decontaminate, op10_simhash, pipeline)}

ORACLE_SQL: dict[str, str] = {"op4_url_filter": URLS_SQL, "op6_secret_scan": SECRETS_SQL}
