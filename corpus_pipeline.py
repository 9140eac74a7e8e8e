"""Corpus pipeline over ``documents``: five stages, each on all that the one before kept.

1. quality: documents that the classifier scores below 0.5 go.
2. lines: common blocks of lines go from the later document; a document that loses all its text goes.
3. near_copies: one document of each SimHash group stays, the one with the smallest id; rows of one id with
   unlike texts are documents of their own.
4. secrets: secrets in the texts are replaced by a mark; no document goes.
5. packing: the documents' pieces in padded batches.

All stages but the last return the columns they were given. ``n_chars`` follows a text that a
stage changes. Rows with a null id are documents like any other. Columns may have any names; one that is
called like a column that packing adds is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigstrata.llm import line_dedup, packing, quality_knn, secret_scan, simhash_dedup
from sigstrata.llm.common import pinned, table
from sigstrata.session import delete_path, scratch_path


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _apart(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns renamed that an operator's results would replace, and their new names."""
    names = {c: _free(docs, f"own {c}") for c in docs.columns if c.lower() in results}
    return docs.withColumnsRenamed(names), names


def _with_text(found: DataFrame, text: Column, changed: Column, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` with the new text, and its length where it changed."""
    new = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n = F.col(names.get("n_chars", "n_chars"))
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(n)
    return found.select(*[new.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return quality_knn.score(docs, model, out=score).where(F.col(score) >= 0.5).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given, names = _apart(docs, "deleted_lines", "partners")
    found, cut = line_dedup.remove_common_blocks(given), F.size("deleted_lines") > 0
    kept = found.where(~cut | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    return _with_text(kept, F.col("text"), cut, docs, names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.corpus_samples(docs))
    given, names = _apart(docs, "rules", "secrets")
    return _with_text(secret_scan.scan(given, model), secret_scan.redacted(F.col("text"), F.col("secrets")),
                      F.size("secrets") > 0, docs, names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", packed)]

#: The stages learn models and build groups, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` in order to ``documents``, each on what the one before wrote."""
    docs, written = table(spark, sf_dir, "documents"), []
    try:
        for at, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if at < len(STAGES) - 1:
                written.append(scratch_path(spark, "corpus"))
                docs.write.parquet(written[-1])
                docs = spark.read.parquet(written[-1])
        return pinned(docs)
    finally:
        for path in written:
            delete_path(spark, path)
