"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import ann, audit, decontaminate, lm, manifest, mixing, preferences, records, secrets, simhash, substrings, toxicity, warc
from barloom.llm.common import table
from barloom.llm.registry import ORACLES, QUERIES, query
from barloom.llm.subwords import default_path

__all__ = ["ORACLES", "QUERIES"]


@query("op1_warc_archives", warc.PAGES_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as read back from the converted archives."""
    found = warc.archive_pages(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_preference_pairs", preferences.NEIGHBOURS_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and masked completions of each even conversation against the next."""
    return preferences.format_neighbours(table(spark, folder, "conversations"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_print(found["fp"]).alias("fingerprint"), "component_id")


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_lm_scores")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline and model log probability of every document."""
    return lm.score(table(spark, folder, "documents"), default_path())


@query("op6_substring_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that are left when repeats of 20 words or more have gone."""
    found = substrings.repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_benchmark_decontamination", decontaminate.REPORT_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and test items of every document."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_mix_sources", mixing.MIX_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    plan = mixing.plan_mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query("op9_token_records")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Position, length and checksum of every document's token record, read back from the files."""
    return records.token_records(table(spark, folder, "documents"), default_path())


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_filter_audit", audit.AUDIT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every order of five text filters, step by step, for every source."""
    return audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_secret_scans", secrets.SCAN_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan_documents(spark, folder)


@query("op13_merkle_manifest", manifest.MANIFEST_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, proof and check of every document."""
    return manifest.verified_documents(table(spark, folder, "documents"))
