"""Every operator on small tables with nulls, empty and long texts, ties and repeated rows."""

import random
import zlib

import brute
import numpy as np
import pytest
from messy_rows import LONG, MESSY
from pyspark.sql import functions as F

from tradeflow.llm import (
    decontaminate,
    jaccard,
    packing,
    page_text,
    quality,
    secret_scan,
    sharding,
    substrings,
    topk,
    toxicity,
)
from tradeflow.llm.components import components

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, "
    "n_words string, spans string, component_id string, blob string"
)


@pytest.fixture
def docs(spark):
    """Documents from (id, text); the other columns clash with results and hold nulls."""

    def build(rows):
        full = [(i, t, None, "s", None if t is None else len(t), None, "x", None, "y", "z") for i, t in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture
def messy(docs):
    return docs(MESSY)


NAMED = [(i, t) for i, t in MESSY if i is not None]


def by_id(df, *columns):
    return {row["doc_id"]: tuple(row[c] for c in columns) for row in df.collect() if row["doc_id"] is not None}


@pytest.mark.parametrize("limit", [200_000, 3])
def test_leaks_in_one_set_or_in_blocks(spark, messy, limit):
    items = [(1, "A,b C-d e f g h i j k"), (2, "short TEXT"), (3, None), (4, ""), (None, "x y"), (1, "w5 w6 w7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leak_report(
        decontaminate.find_leaks(messy, bench, broadcast_windows=limit)
    )
    want = brute.leaks(NAMED, items)
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert got.count() == len(MESSY)
    assert decontaminate.drop_leaking_documents(messy, bench).columns == messy.columns
    cut = decontaminate.cut_leaking_spans(messy, bench)
    assert by_id(cut, "text")[6] == ("",) and by_id(cut, "text")[3] == (None,)


def test_repeats(messy, docs):
    columns = ("n_words", "n_removed", "kept_sha256")
    assert by_id(substrings.remove_repeats(messy), *columns) == brute.repeats(NAMED)
    random.seed(3)
    few = [(i, " ".join(random.choices("abc", k=random.randint(0, 60)))) for i in range(60)]
    assert by_id(substrings.remove_repeats(docs(few), size=7), *columns) == brute.repeats(few, 7)
    assert substrings.remove_repeats(docs([]), with_text=True).collect() == []


def test_links(messy, docs):
    got = by_id(jaccard.linked_components(messy), "n_shingles", "component_id")
    assert got == brute.linked(NAMED)
    random.seed(5)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = f"u{random.randrange(40)}"
        rows.append((i, " ".join(words)))
    want = brute.linked(rows)
    for paired, blocks in ((64, 512), (4, 16)):
        found = jaccard.linked_components(docs(rows), paired=paired, block_sets=blocks)
        assert by_id(found, "n_shingles", "component_id") == want


def test_sets_that_travel_grow_with_near_copies_not_with_blocks(docs, monkeypatch):
    """Each token of a group of near copies sent every set to every pair of its blocks."""
    random.seed(8)
    rows = []
    for i in range(200):
        words = [f"v{k}" for k in range(120)]
        for k in random.sample(range(120), random.randint(0, 2)):
            words[k] = f"u{random.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sent, joined = [], jaccard._joined
    monkeypatch.setattr(jaccard, "_joined", lambda sets, percent: (sent.append(sets.count()), joined(sets, percent))[1])
    found = jaccard.linked_components(docs(rows), paired=4, block_sets=16)
    assert by_id(found, "n_shingles", "component_id") == brute.linked(rows)
    assert sum(sent) <= 4 * jaccard.HUBS * len(rows)


def test_texts_that_share_a_line_make_no_pairs(docs, monkeypatch):
    """They share a few prefix tokens, linked sets of about their size more than that."""
    random.seed(9)
    line = " ".join(f"line{k}" for k in range(12))
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(random.randint(190, 200))), line])) for i in range(80)]
    rows += [(100 + i, f"{text} end{i}") for i, text in rows[:5]]
    near, met = jaccard._near, []
    monkeypatch.setattr(jaccard, "_near", lambda pairs, *rest: (met.append(pairs.count()), near(pairs, *rest))[1])
    monkeypatch.setattr(jaccard, "_bucket_counts", _level_counts(jaccard._bucket_counts))
    found = jaccard.linked_components(docs(rows))
    assert by_id(found, "n_shingles", "component_id") == brute.linked(rows)
    assert met == [5]


def _level_counts(counted):
    """The first call's counts, by which tokens are ordered, all the same: order by hash alone."""
    return lambda rows, hashes: counted(rows, hashes) * (0 if rows.columns == ["text"] else 1)


def test_prefixes_keep_all_pairs_that_link():
    random.seed(10)
    for percent in (80, 90):
        sets = [sorted(random.sample(range(60), random.randint(20, 45))) for _ in range(30)]
        sets += [s[:-1] for s in sets] + [sorted({*s, 60 + k % 3}) for k, s in enumerate(sets)]
        order = random.sample(range(63), 63)
        prefixes = [
            np.array(sorted(s, key=order.index)[: len(s) - jaccard.least_overlap_of_equal(len(s), percent) + 1])
            for s in sets
        ]
        linked, found = {}, {}
        for a, s in enumerate(sets):
            for b, o in enumerate(sets[:a]):
                both = len({*s} & {*o})
                if 100 * both >= percent * (len(s) + len(o) - both) and a % 7 != b % 7:
                    linked[b, a] = min({*prefixes[a].tolist()} & {*prefixes[b].tolist()})
        for token in range(63):
            held = [k for k in range(len(sets)) if token in prefixes[k]]
            if len(held) > 1:
                sizes, roots = np.array([len(sets[k]) for k in held]), np.array([k % 7 for k in held])
                flags = np.ones(len(held), bool)
                made = jaccard.near_prefixes(token, sizes, roots, flags, flags, [prefixes[k] for k in held], percent)
                for x, y in zip(*made, strict=True):
                    assert sizes[x] >= sizes[y] and roots[x] != roots[y]
                    pair = tuple(sorted((held[x], held[y])))
                    assert pair not in found
                    found[pair] = token
        assert linked and linked.items() <= found.items() and len(found) < 90 * 89 / 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 99)], "u long, v long")
    assert dict(components(edges).collect()) == {k: 0 for k in range(1, 31)} | {100: 99}


def test_tree_prunes_nothing_that_links():
    random.seed(7)
    sets = [np.array(sorted(random.sample(range(60), random.randint(20, 45)))) for _ in range(80)]
    sets += [np.delete(s, [3, 9]) for s in sets[:40]]
    tree, held = jaccard.PrefixTree(sets), np.zeros(60, bool)
    for s in sets:
        held[:] = False
        held[s] = True
        want = {
            k
            for k, o in enumerate(sets)
            if 100 * len(set(s) & set(o)) >= 90 * len(set(s) | set(o))
        }
        assert set(tree.linked(s, held)) == want


def test_secrets_and_ledger(messy, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = secret_scan.scan_history(messy, ledger, path_col="doc_id")
    columns = ("n_assign", "n_access", "n_hex", "base_sha256")
    assert by_id(secret_scan.span_report(first), *columns) == brute.secrets(NAMED)
    spark = messy.sparkSession
    before = secret_scan.Ledger(spark, ledger).rows("1").count()
    again = secret_scan.scan_history(messy.union(messy), ledger, path_col="doc_id")
    assert again.count() == 2 * len(MESSY)
    assert secret_scan.Ledger(spark, ledger).rows("1").count() == before == len({t or "" for _, t in MESSY})
    clean = by_id(secret_scan.redact(messy, first), "text")
    assert "AKIA" not in clean[12][0] and "[access]" in clean[12][0] and clean[3] == (None,)


def test_running_sums_over_blocks(spark):
    rows = spark.createDataFrame([([3] * 1000,), ([],), ([5],)], "x array<bigint>")
    sums = [r[0] for r in rows.select(secret_scan._running_sums(F.col("x"))).collect()]
    assert sums == [list(range(3, 3001, 3)), [], [5]]


def test_pieces_and_packing(messy):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    capacity = packing.Capacity()
    rows = packing.pack(packing.token_pieces(messy, capacity.tokens), capacity).collect()
    texts = dict(MESSY)
    for i in texts:
        ids = [*exact.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in pieces][0] == 0 and sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert r["length"] == 2048 or r["piece"] == 0
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


@pytest.mark.parametrize("text", ["<|endoftext|> a", "\x85\x1c  x", "日本語 text", "a" * 3000, "퟿ ​"])
def test_ids_equal_the_tokenizer(text):
    encoder = packing.Encoder(packing.tokenizer_folder())
    assert encoder.ids(text) == encoder.exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_all_capacities_hold(measure):
    capacity = packing.Capacity(tokens=100, documents=4, attention=3000, measure=measure)
    fit, held = packing.BestFit(capacity), {}
    random.seed(1)
    for length in sorted((random.randint(1, 50) for _ in range(500)), reverse=True):
        sequence, offset = fit.place(length)
        assert sum(held.setdefault(sequence, [])) == offset
        held[sequence].append(length)
    for lengths in held.values():
        assert sum(lengths) <= 100 and len(lengths) <= 4 and sum(x * x for x in lengths) <= 3000


def test_prefix_tree_orders_sets_without_lists_of_numbers():
    import tracemalloc

    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(1 << 40, 20_000)) for _ in range(20)] + [np.arange(k) for k in (3, 1, 2)]
    assert sorted(range(23), key=lambda k: jaccard._path_key(sets[k])) == sorted(range(23), key=lambda k: sets[k].tolist())
    tracemalloc.start()
    jaccard.PrefixTree(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * sum(s.nbytes for s in sets)


@pytest.mark.parametrize("measure", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 4, 3000), (2048, 2048, 2048 * 2048)])
def test_each_piece_goes_to_the_best_of_all_open_sequences(measure, limits):
    capacity = packing.Capacity(*limits, measure=measure)
    fit, left = packing.BestFit(capacity), {}
    random.seed(3)
    most = capacity.tokens // 2
    lengths = sorted((random.randint(most // 3, most) for _ in range(300)), reverse=True)
    for length in [*lengths, *(random.randint(1, most) for _ in range(500))]:
        values = {
            s: fit._better(*state, length) for s, state in left.items() if state[0] >= length and state[2] >= length * length
        }
        sequence, offset = fit.place(length)
        assert (sequence in left) == bool(values)
        tokens, documents, attention = left.pop(sequence, limits)
        assert offset == limits[0] - tokens
        if values:
            assert values[sequence] == pytest.approx(min(values.values()), rel=1e-12, abs=1e-15)
        now = (tokens - length, documents - 1, attention - length * length)
        if all(now):
            left[sequence] = now


def test_shards_fit_or_cannot_be_split(docs):
    random.seed(2)
    rows = [(i % 40, "x" * random.randint(0, 90)) for i in range(300)] + [(7, "y" * 500)] * 2 + [(None, None)]
    got = sharding.assign_shards(docs(rows), limit=400).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["n_bytes"]
    for r in got:
        assert sizes[r["shard"]] == r["shard_bytes"] and r["fits"] == (r["shard_bytes"] <= 400)
        assert r["fits"] or r["n_bytes"] == 500
        assert not any(o != r["shard"] and o.startswith(r["shard"]) for o in sizes)
    assert sharding.assign_shards(docs([])).count() == 0


def test_top_k(spark):
    random.seed(4)
    rows = [(i, [random.choice([-0.5, 0.1, 0.25, 0.9]) for _ in range(6)]) for i in range(230)]
    rows += [(1000, None), (1001, [None] + [0.1] * 5), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (16_384, 40):
        got = topk.top_k(table, block_vectors=size, block_queries=2).collect()
        assert sorted(map(tuple, got)) == brute.nearest(rows)
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(one).collect() == []
    repeated = [(0, [0.5, 0.5]), (1, [0.1, 0.1]), (1, [0.9, 0.9]), (2, [0.3, 0.0]), (50, [0.2, 0.2]), (50, [0.4, 0.1])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(repeated, "vec_id long, embedding array<double>")).collect()))
    assert got == brute.nearest(repeated) and got[0] == (0, 1, 1, 58880)
    assert [r[2] for r in got if r[0] == 50] == [1, 1, 0, 0, 2]


def test_page_text(spark):
    page = (
        "<head><title>t</title></head><p>a &amp; <b>b<p hidden>no<ul><li>x<li>y<ol start=3><li>z</ol></ul>"
        "<table><tr><td>1<th>long<tr><td>wide<td>2</table><pre> k\n  l</pre><script>no</script>"
        "<div style='display: none'>no</div>end<br>line<!-- no -->"
    )
    text = page_text.render(page)
    assert text.split("\n") == [
        "a & b", "", "- x", "- y", "", "  3. z", "", "1    | long", "wide | 2", "", " k", "  l", "", "end", "line",
    ]
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<" * 50), (4, "<div>" * 3000 + "x")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in page_text.page_text(rows).collect()}
    assert got[1] == got[2] == "" and got[4] == "x"


def test_toxicity_tells_labelled_words_apart(docs, spark):
    random.seed(6)
    common = [f"{a}{b}" for a in ("ther", "ond", "ing", "est") for b in ("and", "ly", "ion", "er", "th")]
    bad = ["grobnik", "zulfert", "plimvok"]
    rows, labels = [], []
    for i in range(400):
        words, toxic = random.choices(common, k=40), int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[random.randrange(40)] = random.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    table = docs([*rows, (900, None), (901, ""), (None, "a")])
    known = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(table, toxicity.fit(table, known), keep=["doc_id"]).collect()
    got = {r["doc_id"]: r["predicted"] for r in scored}
    assert len(scored) == 403 and got[900] == got[901] == 0
    unseen = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == int(i % 4 == 0) for i in unseen]) > 0.95
    none = toxicity.fit(table, known.filter("false"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(table, none).collect())


def test_quality_views_agree(docs, spark):
    random.seed(8)
    rows = [(i, " ".join(random.choices("abcdefghijk", k=60)) if i % 2 else "x%% y&& " * 30) for i in range(300)]
    table = docs([*rows, (900, None), (None, "")])
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(table, quality.fit(table, known)).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(300)) and 0 <= got[900]["score"] <= 1
    assert len(got) == 302


def test_quality_learns_from_every_unlabelled_row(docs, spark):
    """One source is among unlabelled rows only, and rare there; more rows than a pool of 4,000 held."""
    random.seed(9)
    good, bad = [" ".join(random.choices("abcdefghijk", k=60)) for _ in range(50)], "x%% y&& " * 30
    rows = [(i, good[i // 2 % 50] if i % 2 else bad, None, "ab"[i % 2], 480) for i in range(6000)]
    rows += [(i, bad, None, "rare", 480) for i in range(6000, 6020)] + [(6020, bad * 250, None, "long", 480)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, known)
    new, rare, long = (quality.metadata_view(None, source, 480) for source in ("never", "rare", "long"))
    scores = model.metadata.scores(np.array([new, rare, long]))
    assert scores[1] < 0.3 and scores[1] < scores[0] - 0.1 and scores[2] < scores[0] - 0.02


def test_long_text_is_whole(docs):
    found = substrings.remove_repeats(docs([(1, LONG), (2, LONG)]), with_text=True).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(1, 0), (2, 4000)]
