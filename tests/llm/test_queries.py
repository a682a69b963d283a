"""The registered queries and the pipeline on the smallest tables."""

import sys
from pathlib import Path

import brute
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402
from tradeflow.llm.queries import queries  # noqa: E402
from tradeflow.llm.texts import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="the tables are not here")


def test_ten_operators_and_their_numbers():
    assert [name.split("_")[0] for name in queries()] == [f"op{n}" for n in range(1, 14)]


def test_contracts(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    want = {
        "op2_decontamination": brute.leaks(docs, items),
        "op4_substring_dedup": brute.repeats(docs),
        "op7_ngram_jaccard": brute.linked(docs),
    }
    for name, rows in want.items():
        got = queries()[name](spark, SMALL).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == rows, name
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").collect()]
    got = queries()["op9_exact_top_k"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == brute.nearest(vectors)


def test_stages_by_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stage(spark, docs, SMALL) for name, stage in stages.items() if name != "best-fit packing"}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in kept.items()}
    assert all(df.columns == docs.columns for df in kept.values())
    near = brute.linked(rows, corpus_pipeline.NEAR_WORDS, (corpus_pipeline.NEAR_PERCENT, 100))
    assert ids["n-gram Jaccard join"] == {i for i, (_, c) in near.items() if i == c}
    assert ids["benchmark decontamination"] == {i for i, x in brute.leaks(rows, items).items() if not x[4]}
    clean = {r["doc_id"]: r["text"] for r in kept["secret scans"].collect()}
    assert set(clean) == dict(rows).keys()
    for i, text in rows:
        assert clean[i] == text if not brute.base_spans(text) else not brute.base_spans(clean[i])


def test_near_copies_are_of_five_words_and_four_fifths(spark):
    """Documents that 3 words at 90 % leave apart: the stage has values of its own, op7 keeps its."""
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:]])), (3, " ".join(words[:40]))]
    rows += [(4, " ".join([*words[:30], "y", *words[31:60], "z", *words[61:]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SMALL, "documents").schema)
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SMALL)
    want = {i for i, (_, c) in brute.linked(rows, 5, (80, 100)).items() if i == c}
    assert want != {i for i, (_, c) in brute.linked(rows).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    real = table(spark, SMALL, "documents")
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, real, SMALL)
    pairs = [(r["doc_id"], r["text"]) for r in real.collect()]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute.linked(pairs, 5, (80, 100)).items() if i == c}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and out.columns[-2:] == ["sequence_id", "offset"]


def test_packing_stage_compares_all_open_sequences(spark):
    """The best sequence for the last piece has less attention left than 30 that are fuller by tokens."""
    lengths = [1390] + [700] * 60 + [300]
    rows = [(i, "a" + " a" * (n - 2), "en", "s", 2 * n - 3) for i, n in enumerate(lengths)]
    docs = spark.createDataFrame(rows, table(spark, SMALL, "documents").schema)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, SMALL).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    placed = {r["doc_id"]: r for r in out}
    assert [placed[i]["length"] for i in range(len(lengths))] == lengths
    assert len({r["sequence_id"] for r in out}) == 31
    assert (placed[61]["sequence_id"], placed[61]["offset"]) == (placed[0]["sequence_id"], 1390)
