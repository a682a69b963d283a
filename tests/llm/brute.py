"""What the operators must return, worked out plainly in Python on small tables."""

import hashlib
import math
import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaks(docs, items, size=10):
    """{doc: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k : k + n])].add(None if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (key := tuple(words[k : k + n])) in windows:
                    found |= windows[key] - {None}
                    hit |= set(range(k, k + n))
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def repeats(docs, size=13):
    """{doc: (n_words, n_removed, kept_sha256)}"""
    first = {}
    split = {doc: SPACE.findall(text or "") for doc, text in docs}
    for doc in sorted(split):
        words = split[doc]
        for k in range(len(words) - size + 1):
            first.setdefault(hash(tuple(words[k : k + size])), doc)
    out = {}
    for doc, words in split.items():
        gone = set()
        for k in range(len(words) - size + 1):
            if first[hash(tuple(words[k : k + size]))] < doc:
                gone |= set(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc] = (len(words), len(gone), sha(kept))
    return out


def shingles(text, n=3):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def linked(docs, n=3, over=(90, 100)):
    """{doc: (n_shingles, component)} by counting shared shingles of all pairs."""
    sets = {doc: shingles(text, n) for doc, text in docs}
    members = defaultdict(list)
    for doc, s in sorted(sets.items()):
        members[s].append(doc)
    distinct = [s for s in members if s]
    holders = defaultdict(list)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for s in sorted(distinct, key=len):
        shared = defaultdict(int)
        for gram in s:
            for other in holders[gram]:
                shared[other] += 1
        for other, both in shared.items():
            if over[1] * both >= over[0] * (len(s) + len(other) - both):
                parent[root(s)] = root(other)
        for gram in s:
            holders[gram].append(s)
    least = {}
    for s in distinct:
        r = root(s)
        least[r] = min(least.get(r, math.inf), members[s][0])
    return {doc: (len(s), least[root(s)] if s else doc) for doc, s in sets.items()}


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def secrets(docs):
    """{doc: (n_assign, n_access, n_hex, base_sha256)}"""
    kinds = ("assign", "access", "hex")
    out = {}
    for doc, text in docs:
        spans = base_spans(text)
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        out[doc] = (*(sum(k == n for _, k, _ in spans) for n in range(3)), sha(joined))
    return out


def nearest(rows, k=5, every=50):
    """[(query_id, rank, vec_id, score)]"""
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        scored = [
            (-sum(a * b for a, b in zip(v, w)), i) for p, v in good if p == q for i, w in good if i != q
        ]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)
