"""Token counts against the tokenizers library itself."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tradeflow.llm.queries import queries  # noqa: E402
from tradeflow.llm.token_count import ByteBpe, count_tokens, vocabulary_path  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")
SMALL = "/root/testdata/sf0.001"

ODD = [
    None,
    "",
    " ",
    "a<|endoftext|>b",
    "<|endoftext|><|endoftext|>",
    "<|endoftext",
    "  hello   world  \n\n x",
    "ééé 123456 '''s 'll",
    "x" * 20_000,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "日本語のテキスト 🙂🙂 　 tab\tend",
    "word " * 5000,
]


def library_counts(texts):
    model = tokenizers.Tokenizer.from_file(vocabulary_path())
    return [len(e.ids) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library_on_odd_texts():
    assert ByteBpe(vocabulary_path()).counts(ODD) == library_counts(ODD)


def test_query_on_documents_equals_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r[0] for r in rows], library_counts([r[1] for r in rows]), strict=True))
    got = queries()["op11_token_counts"](spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == want[r["doc_id"]]
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert [c for c in queries()["op11_token_counts"](spark, SMALL).columns] == [
        "doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_messy_rows_nulls_repeats_clashing_columns_and_empty_tables(spark):
    rows = [(None, None, 7), (1, "", 7), (2, "hi there", 7), (2, "hi there", 7), (3, "x" * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    df = df.withColumn("over_limit", df["doc_id"]).withColumn("n_bytes", df["doc_id"])
    got = [tuple(r) for r in count_tokens(df).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    want_tokens = library_counts([r[1] for r in rows])
    assert got == [
        (r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, want_tokens, strict=True)
    ]
    assert count_tokens(df.limit(0)).count() == 0
