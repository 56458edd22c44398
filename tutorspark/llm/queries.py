"""The operators of this package as registered queries over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorspark.llm import (
    bin_packing,
    cover_tree,
    gray_simhash,
    impact_index,
    kronecker_negatives,
    language_crf,
    page_wrappers,
    prefix_trie,
    pseudonyms,
    secret_scan,
    seed_extend,
    source_mix,
    url_reputation,
)

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the URL query, as (verdict, host, path prefix).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


#: A user passes a secret of their own; this one makes reruns comparable.
PSEUDONYM_KEY = "tutorspark example key"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mix.mix_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    scanned = secret_scan.scan_texts(read(spark, sf_dir, "documents"), rules, columns=["doc_id"])
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *map(number, kinds),
        F.sha2(secret_scan.span_text("spans", kinds), 256).alias("base_sha256"),
        secret_scan.span_text("spans").alias("spans"),
    )


def op4_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.pack(read(spark, sf_dir, "documents"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = language_crf.identify(read(spark, sf_dir, "documents"))
    return labelled.select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op6_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(read(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = seed_extend.remove_repeats(read(spark, sf_dir, "documents"), threshold=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pseudonyms.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return new.select("doc_id", "text", F.size("pseudonyms").cast("long").alias("n_values"))


def op10_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = gray_simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=2)
    return linked.withColumn("fingerprint", gray_simhash.hex_digits(F.col("fingerprint")))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return kronecker_negatives.hard_negatives(vectors, positives=5, negatives=3, band=(50, 95), every=50, label=label)


def op12_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.main_text(read(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def llm_queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_url_reputation,
            op2_source_mix,
            op3_secret_scan,
            op4_bin_packing,
            op5_language_crf,
            op6_impact_index,
            op7_cover_tree,
            op8_seed_extend,
            op9_pseudonyms,
            op10_gray_simhash,
            op11_kronecker_negatives,
            op12_page_wrappers,
            op13_prefix_trie,
        )
    }
