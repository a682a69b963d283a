"""The corpus pipeline: reject, deduplicate, decontaminate, redact, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.llm import decontaminate, jaccard, packing, secret_scan, toxicity
from tradeflow.llm.texts import staged, table
from tradeflow.session import work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies: shingles of so many words, and the share of them in percent that two documents have in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from labelled ones that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.filter("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingle sets link, also through others, the one of least id stays.

    Documents without words are in no group and stay. Rows that repeat a kept id stay
    with it.
    """
    found = jaccard.linked_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.drop_leaking_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in every text; n_chars follows the text."""
    history = docs.select("doc_id", "text")
    found = secret_scan.scan_history(history, work_dir(spark, "ledger"), path_col="doc_id")
    clean = secret_scan.redact(docs, found)
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its place in a training sequence."""
    capacity = packing.Capacity()
    return packing.pack(packing.token_pieces(docs, capacity.tokens), capacity)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage{number}")
    return docs


#: Model scores and token ids are not expressible in SQL.
ORACLE_SQL = None
