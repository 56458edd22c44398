"""From raw documents to packed training sequences: five stages, each an operator of ``tutorspark.llm``.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the
next stage's documents.  All stages but the last return the columns of ``documents``; columns that a
stage does not know are carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorspark.llm import bin_packing, gray_simhash, language_crf, secret_scan, source_mix
from tutorspark.llm.storage import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least share of a document's words that its language must have; below, it has no clear language.
LEAST_SHARE = 0.3
SHINGLE_WORDS = 3
MOST_BITS = 2
SECRET_MARK = "[SECRET]"
BIN_WORDS = 2048

#: The stages run a trained field, hash shingles with XXH64 and break ties by hash: SQL cannot say it.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with neutral column names, and these names by the old ones."""
    names = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(old) for old, c in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus teaches; texts without a letter (NULL and empty
    ones too) go, and texts in which no language has LEAST_SHARE of the words.  Repeated rows stay or
    go together.  If there is nothing to learn from, nothing can be told apart and all with a letter
    go as unknown, too."""
    rows, names = _numbered(docs)
    field = language_crf.fit_on(rows, names["doc_id"], names["text"], names["lang"])
    labelled = language_crf.label_languages(rows, field, names["text"], with_runs=False)
    clear = (F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return _named(labelled.filter(clear), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; see the operator
    for NULL ids and repeated rows."""
    rows, names = _numbered(docs)
    kept = gray_simhash.drop_near_duplicates(rows, names["doc_id"], names["text"], SHINGLE_WORDS, MOST_BITS)
    return _named(kept, names)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret, a private key with its body; n_chars counts
    the new text's characters."""
    rows, names = _numbered(docs)
    masked = secret_scan.mask(rows, secret_scan.BASE_RULES + secret_scan.MORE_RULES, names["text"], SECRET_MARK)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed = F.col(names["text"]).contains(SECRET_MARK)
        masked = masked.withColumn(
            names["n_chars"], F.when(changed, F.length(names["text"]).cast(kind)).otherwise(F.col(names["n_chars"]))
        )
    return _named(masked, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents by their sources' weights: some left out, some repeated as equal rows."""
    rows, names = _numbered(docs)
    return _named(source_mix.mix(rows, names["doc_id"], names["text"], names["source"]), names)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins; see the operator for its columns and for empty texts."""
    rows, names = _numbered(docs)
    return bin_packing.pack(rows, BIN_WORDS, names["doc_id"], names["text"], names["source"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
