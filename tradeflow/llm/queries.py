"""The operators here as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeflow.session import work_dir

from . import (
    collocations,
    decontaminate,
    jaccard,
    packing,
    page_text,
    quality,
    resampling,
    secret_scan,
    sharding,
    substrings,
    topk,
    token_count,
    toxicity,
)
from .texts import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.with_held_out(toxicity.score(docs, model, keep=["doc_id"]))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    leaks = decontaminate.find_leaks(docs, table(spark, folder, "benchmark"), keep=["doc_id"])
    return decontaminate.leak_report(leaks)


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    capacity = packing.Capacity()
    pieces = packing.token_pieces(table(spark, folder, "documents"), capacity.tokens)
    return packing.pack(pieces, capacity)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked_components(table(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.scan_history(docs, work_dir(spark, "ledger"), path_col="doc_id")
    return secret_scan.span_report(found)


def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.page_text(table(spark, folder, "pages"), keep=["page_id", "url"])


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, keep=["doc_id"])


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    named = {
        name: made for name, made in globals().items() if name.startswith("op") and callable(made)
    }
    return dict(sorted(named.items(), key=lambda item: int(item[0][2:].split("_")[0])))
