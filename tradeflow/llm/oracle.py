"""The queries here as SQL, where SQL can express them on whole tables in a short time.

Model scores, token ids, shard directories, best-fit places and page layout have none.
"""

from __future__ import annotations

from .secret_scan import ADDED_RULES

#: Every window of a benchmark item, then the document positions where one starts.
DECONTAMINATION = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS n, words[k : k + least(len(words), 10) - 1] AS piece
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k
          FROM item_words WHERE len(words) > 0)
), doc_windows AS (
    SELECT doc_id, n, k, words[k : k + n - 1] AS piece
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k
          FROM doc_words, (SELECT DISTINCT n FROM item_windows))
), occurring AS (
    SELECT doc_id, item_id, n, k FROM doc_windows JOIN item_windows USING (n, piece)
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occurring) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurring) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The first document of every window, and the words that later documents lose.
SUBSTRINGS = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, k, array_to_string(words[k : k + 12], ' ') AS piece
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM split)
), firsts AS (
    SELECT piece, min(doc_id) AS first FROM windows GROUP BY piece HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p
    FROM windows JOIN firsts USING (piece) WHERE first < doc_id
), marked AS (
    SELECT doc_id, w.p AS p, w.word AS word, gone.p IS NOT NULL AS removed
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM split) w
    LEFT JOIN gone USING (doc_id, p)
), kept AS (
    SELECT doc_id, count(*) FILTER (removed) AS n_removed,
           string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS rest
    FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

#: Sets as distinct rows, their links by shared shingles, labels spread until none changes.
JACCARD = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(
        range(1, greatest(len(words) - 2, 1) + 1), lambda k: array_to_string(words[k : k + 2], ' ')))) AS members
    FROM split WHERE len(words) > 0
), named AS (
    SELECT min(doc_id) AS node, members, len(members) AS n FROM shingles GROUP BY members
), holders AS (
    SELECT node, n, unnest(members) AS member FROM named
), links AS (
    SELECT a.node AS u, b.node AS v
    FROM holders a JOIN holders b ON a.member = b.member AND a.node < b.node
    GROUP BY a.node, b.node, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
    SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
    SELECT node AS start, node AS now FROM named
    UNION
    SELECT start, v FROM reached JOIN both_ways ON now = u
), least_of AS (
    SELECT start AS node, min(now) AS component_id FROM reached GROUP BY start
)
SELECT split.doc_id, CAST(coalesce(named.n, 0) AS BIGINT) AS n_shingles,
       coalesce(component_id, split.doc_id) AS component_id
FROM split LEFT JOIN shingles USING (doc_id)
LEFT JOIN named ON shingles.members = named.members
LEFT JOIN least_of USING (node)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def secrets() -> str:
    """Spans as sums of the lengths of gaps and matches before them."""
    words = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    rules = [
        ("assign", rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        *((rule.kind, rule.pattern, rule.group, rule.least) for rule in ADDED_RULES),
    ]
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {number} AS number, {least} AS least,
            regexp_extract_all(whole, $${pattern}$$, 0) AS found,
            regexp_extract_all(whole, $${pattern}$$, {group}) AS tested,
            string_split_regex(whole, $${pattern}$$) AS gaps
        FROM texts"""
        for number, (kind, pattern, group, least) in enumerate(rules)
    )
    return f"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS whole FROM documents
), matches AS (
    {found}
), listed AS (
    SELECT *, unnest(range(1, len(found) + 1)) AS k FROM matches
), spans AS (
    SELECT doc_id, kind, number, stop - length(found[k]) AS start, stop
    FROM (SELECT *, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g)))
                 + list_sum(list_transform(found[1:k], lambda m: length(m))) AS BIGINT) AS stop
          FROM listed)
    WHERE length(tested[k]) >= least
), joined AS (
    SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access,
           count(*) FILTER (number = 2) AS n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number)
               FILTER (number < 3) AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)
"""


#: Every query against every vector.
TOP_K = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: Every phrase of 1 to 5 words within pieces, counted per language; cuts and holders by joins.
COLLOCATIONS = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, m, w[k : k + m - 1] AS g, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k
          FROM words, (SELECT unnest(range(1, 6)) AS m) AS sizes WHERE len(w) >= m)
    GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.g, c.m, c.f AS a, t.n, k, h.f AS l, r.f AS r,
           CAST((1000::HUGEINT * c.f * t.n) // (h.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM (SELECT lang, g, m, f, unnest(range(1, m)) AS k FROM grams WHERE m >= 2) AS c
    JOIN totals AS t USING (lang)
    JOIN grams AS h ON h.lang = c.lang AND h.g = c.g[1 : k]
    JOIN grams AS r ON r.lang = c.lang AND r.g = c.g[k + 1 : c.m]
), best AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS pick FROM cuts
    ) WHERE pick = 1
), holders AS (
    SELECT lang, g[p : p + span - 1] AS g, max(f) AS held
    FROM (SELECT lang, g, f, span, unnest(range(1, m - span + 2)) AS p
          FROM (SELECT lang, g, f, m, unnest(range(2, m)) AS span FROM grams WHERE m >= 3))
    GROUP BY ALL
), kept AS (
    SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score
    FROM best AS b LEFT JOIN holders AS o ON o.lang = b.lang AND o.g = b.g
    WHERE o.held IS NULL OR o.held < b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank
    FROM kept
) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": DECONTAMINATION,
        "op4_substring_dedup": SUBSTRINGS,
        "op7_ngram_jaccard": JACCARD,
        "op8_secret_scan": secrets(),
        "op9_exact_top_k": TOP_K,
        "op13_phrase_collocations": COLLOCATIONS,
    }
