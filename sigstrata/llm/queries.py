"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chat_format, filter_audit, fingerprints, html_extraction, secret_scan, sentencepiece_sampling, source_divergence
from .common import pinned, table
from .embedding_dedup import near_duplicates
from .line_dedup import remove_common_blocks
from .packing import pack
from .pii_surrogates import replace_pii
from .quality_knn import classify
from .simhash_dedup import fingerprint_hex, simhash_groups


CONTROL_CASE = "</s>[INST] ok [/INST]"      # fixed: the text of conversation -1


def op1_chat_format(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame([(-1, 0, "user", CONTROL_CASE), (-1, 1, "assistant", CONTROL_CASE)],
                                 "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.conversations(rows.unionByName(case)))
    return (chats.withColumn("d", chat_format.digest(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", "d.*", F.length("formatted").cast("long").alias("formatted_chars")))


def op2_sentencepiece(spark, d) -> DataFrame:
    docs = sentencepiece_sampling.encode(table(spark, d, "documents"), check="lossless", keep=["doc_id"])
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "lossless", "ids")


def op3_fingerprints(spark, d) -> DataFrame:
    rows = pinned(fingerprints.edited(table(spark, d, "documents")))
    found = fingerprints.count_near(rows, rows.where("doc % 50 = 0"))
    found = found.join(rows.where("doc % 50 = 0").select("doc", "fp"), "fp").select("doc", "n_near")
    fp = F.col("fp")
    return rows.join(found, "doc", "left").select(
        F.col("doc").alias("doc_id"), "n_chars", "edited_sha256", fingerprint_hex(fp).alias("fingerprint"),
        fingerprint_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(fp, F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(fp, F.col("next_fp")).alias("near_next"), "n_near")


def op4_secret_scan(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.corpus_samples(docs)))
    rules, secrets = F.col("rules"), F.col("secrets")
    return found.select(
        "doc_id", *[secret_scan.count_kind(rules, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.written(rules), 256).alias("base_sha256"), secret_scan.written(secrets).alias("spans"),
        secret_scan.count_kind(secrets, "markov").alias("n_markov"))


def op5_simhash_dedup(spark, d) -> DataFrame:
    return simhash_groups(table(spark, d, "documents")).select(
        "doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_packing(spark, d) -> DataFrame:
    return pack(table(spark, d, "documents").select("doc_id", "text"))


def op7_quality(spark, d) -> DataFrame:
    return classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_pii_surrogates(spark, d) -> DataFrame:
    return replace_pii(table(spark, d, "documents").select("doc_id", "text"))


def op9_line_dedup(spark, d) -> DataFrame:
    docs = remove_common_blocks(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("deleted_lines").alias("n_deleted"), "deleted_lines", "partners", "text")


def op10_embedding_dedup(spark, d) -> DataFrame:
    return near_duplicates(table(spark, d, "embeddings"))


def op11_html_extraction(spark, d) -> DataFrame:
    return html_extraction.extract(table(spark, d, "pages").select("page_id", "url", "html"))


def op12_source_divergence(spark, d) -> DataFrame:
    return source_divergence.divergences(table(spark, d, "documents"))


def op13_filter_audit(spark, d) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_fingerprints": op3_fingerprints,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_line_dedup": op9_line_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "op12_source_divergence": source_divergence.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
