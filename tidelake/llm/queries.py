"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import conversations, html_extract, licenses, mixing, near_dedup, packing, quality, ranked_search, sql, substring_dedup, syncmers, topk, toxicity, url_filter
from tidelake.llm._common import held_out, table

# The rules that judge pages.
URL_RULES = [
    url_filter.Rule("org/", True),
    url_filter.Rule("example.org/es/", False),
    url_filter.Rule("example.org/en/1", False),
    url_filter.Rule("com/fr/", True),
    url_filter.Rule("com/de/", False),
]
#: Words of a host that mark a URL as rejected when the models are fitted.
REJECT_WORDS = ["casino", "bets", "pills", "ads", "adult", "spam"]
#: The vocabulary of byte_bpe_50k.json as ranks.
TOKEN_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Its strings that are one id each.
ADDED_TOKENS = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    models = url_filter.fit(url_filter.seed_labels(pages, REJECT_WORDS))
    return url_filter.judge(pages, URL_RULES, models)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    vectors = embeddings.select("vec_id", topk.whole_components(F.col("embedding"), 64).alias("vector"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op6_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(documents, machine, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(documents, model, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKEN_RANKS, public_tokenizers.PATTERN, ADDED_TOKENS)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_syncmers": op3_syncmers,
    "op4_source_mix": op4_source_mix,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_quality_machine": op6_quality_machine,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_hilbert_packing": op9_hilbert_packing,
    "op10_license_scan": op10_license_scan,
    "op11_html_extract": op11_html_extract,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op5_exact_top_k": sql.EXACT_TOP_K,
    "op8_minhash_near_dedup": sql.NEAR_DEDUP,
    "op10_license_scan": sql.LICENSE_SCAN,
    "op11_html_extract": sql.HTML_EXTRACT,
    "op12_ranked_search": sql.RANKED_SEARCH,
}
