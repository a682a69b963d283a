"""N-gram Jaccard join: prefix tokens bring sets together, a prefix tree compares them."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .texts import binary, lower_words, staged, window_hashes, word_hashes

SHINGLE_WORDS = 3
#: Two sets link when 100 * intersection >= percent * union; what callers get who name no percentage.
LINK_PERCENT = 90
#: Shingle counts are kept by this many hash values; they order shingles, rarest first.
ORDER_BUCKETS = 1 << 22
#: Sums of so many buckets are one row when tasks add theirs up.
BUCKETS_A_ROW = 1 << 12
#: Sets that share a token are paired one by one up to this many, beyond it in blocks.
PAIRED = 64
BLOCK_SETS = 512
#: Sets with a token of more sets than PAIRED are first compared with so many sets that resemble them.
HUBS = 4
#: Rows that a task makes sets of, or compares by their bits, at once.
ROWS_AT_ONCE = 1024
#: Tokens that a block's sets are compared by at once.
TOKENS_AT_ONCE = 4096
#: Pairs of a block that are compared by their bits at once.
PAIRS_AT_ONCE = 16_384
_SHIFT = np.uint64(64 - 22)


def shingle_set(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of all words as one where there are fewer."""
    hashes = word_hashes(lower_words(text))
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, min(n, len(hashes))))


def _parts(batches):
    """The batches' rows, up to ROWS_AT_ONCE at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _path_key(members: np.ndarray) -> bytes:
    """Bytes that compare as lists of the members do; a list of Python numbers takes five times as much."""
    return members.astype(">u8").tobytes()


def least_overlap(a, b, percent: int = LINK_PERCENT):
    """The smallest intersection with which sets of a and b members link."""
    return -(-percent * (a + b) // (100 + percent))


def _parity(members: np.ndarray) -> bytes:
    """Bits that say whether an even number of members fell on them; at least twice as many as members."""
    bits = 1 << max(6, int(2 * len(members) - 1).bit_length())
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """At least so many members are in one of two sets only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


@dataclass
class Branch:
    """A stretch of members that all sets below begin with, after those above it."""

    members: np.ndarray
    depth: int  # members down to the end of this stretch
    shortest: int
    longest: int
    sets: list[int] = field(default_factory=list)  # that end here
    below: list[Branch] = field(default_factory=list)


class PrefixTree:
    """Sets in one global order as paths; sets that begin alike share branches."""

    def __init__(self, sets: list[np.ndarray], percent: int = LINK_PERCENT):
        self.percent = percent
        self.root = Branch(np.empty(0, np.int64), 0, 0, 0)
        order = sorted(range(len(sets)), key=lambda k: _path_key(sets[k]))
        path = [self.root]
        previous = np.empty(0, np.int64)
        for k in order:
            members = sets[k]
            least = min(len(previous), len(members))
            unequal = np.flatnonzero(previous[:least] != members[:least])
            shared = int(unequal[0]) if len(unequal) else least
            while path[-1].depth > shared:
                branch = path.pop()
                above = path[-1]
                if above.depth < shared:  # the path parts inside this branch
                    cut = shared - above.depth
                    upper = Branch(branch.members[:cut], shared, 0, 0, below=[branch])
                    branch.members = branch.members[cut:]
                    above.below[-1] = upper
                    path.append(upper)
            if len(members) > path[-1].depth:
                leaf = Branch(members[path[-1].depth :], len(members), 0, 0)
                path[-1].below.append(leaf)
                path.append(leaf)
            path[-1].sets.append(k)
            previous = members
        self._measure()

    def _measure(self) -> None:
        """Sizes of the sets below each branch, the innermost first."""
        listed, k = [self.root], 0
        while k < len(listed):
            listed.extend(listed[k].below)
            k += 1
        for branch in reversed(listed):
            sizes = [branch.depth] if branch.sets else []
            branch.shortest = min([*sizes, *(b.shortest for b in branch.below)], default=0)
            branch.longest = max([*sizes, *(b.longest for b in branch.below)], default=0)

    def linked(self, members: np.ndarray, held: np.ndarray) -> list[int]:
        """Sets that link with `members`; `held` marks them among all members.

        The overlap with a branch is counted once for all sets below it. A branch is
        left when even its most suitable size below cannot reach the overlap it needs
        with what is left of both.
        """
        size, found, open_ = len(members), [], [(self.root, 0)]
        while open_:
            branch, overlap = open_.pop()
            left = size
            if len(branch.members):
                overlap += int(np.count_nonzero(held[branch.members]))
                left = size - int(np.searchsorted(members, branch.members[-1], "right"))
            best = min(max(branch.depth + left, branch.shortest), branch.longest)
            if overlap + min(best - branch.depth, left) < least_overlap(size, best, self.percent):
                continue
            if branch.sets and overlap >= least_overlap(size, branch.depth, self.percent):
                found += branch.sets
            open_ += [(below, overlap) for below in branch.below]
        return found


def link_forest(
    ids: np.ndarray, sets: list[np.ndarray], probes: np.ndarray, stored: np.ndarray, percent: int = LINK_PERCENT
) -> list[tuple[int, int]]:
    """Links between probes and stored sets, no more than connect them: (id, id) pairs."""
    values, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(values), np.int64)
    order[np.lexsort((values, -counts))] = np.arange(len(values))  # shared by most first
    ranked = np.split(order[ranks], np.cumsum([len(s) for s in sets])[:-1])
    ranked = [np.sort(r) for r in ranked]
    kept = np.flatnonzero(stored)
    tree = PrefixTree([ranked[k] for k in kept], percent)
    held = np.zeros(len(values), bool)
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for k in np.flatnonzero(probes):
        held[ranked[k]] = True
        for other in tree.linked(ranked[k], held):
            a, b = root(int(k)), root(int(kept[other]))
            if a != b:
                parent[a] = b
                links.append((int(ids[k]), int(ids[kept[other]])))
        held[ranked[k]] = False
    return links


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> _SHIFT).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """BUCKETS_A_ROW sums in as few bytes each as the largest needs, compressed."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def _unpacked(row: bytes) -> np.ndarray:
    plain = zlib.decompress(row)
    return np.frombuffer(plain, f"<u{len(plain) // BUCKETS_A_ROW}").astype(np.int64)


def _bucket_counts(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How many of the hashes of all rows fall into each bucket; one array whatever the input."""

    def count(batches):
        counts = np.zeros(ORDER_BUCKETS, np.uint32)
        for batch in _parts(batches):
            np.add.at(counts, _buckets(hashes(batch)), np.uint32(1))
        dealt = counts.reshape(-1, BUCKETS_A_ROW)
        seen = np.flatnonzero(dealt.any(axis=1))
        packed = pa.array([_packed(dealt[k]) for k in seen], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), packed], ["k", "packed"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column("k").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + _unpacked(row)
        packed = pa.array([_packed(c) for c in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), packed], ["k", "packed"])

    kind = "k long, packed binary"
    out = np.zeros((ORDER_BUCKETS // BUCKETS_A_ROW, BUCKETS_A_ROW), np.int64)
    for row in rows.mapInArrow(count, kind).repartition("k").mapInArrow(add, kind).collect():
        out[row["k"]] = _unpacked(row["packed"])
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def _nodes_and_tokens(docs: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """A row for each document: its set's hash, size and bits, and the prefix of its order."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        rank = counts.value
        for batch in _parts(batches):
            rows: dict[str, list] = {"f": [], "n": [], "bits": [], "tokens": []}
            for text in binary(batch, "text"):
                members = shingle_set(text, n)
                size = len(members)
                prefix = size - int(least_overlap_of_equal(size, percent)) + 1 if size else 0
                order = np.lexsort((members, rank[_buckets(members)]))
                rows["f"].append(xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63))
                rows["n"].append(size)
                rows["bits"].append(_parity(members))
                rows["tokens"].append(members[order[:prefix]].view(np.int64))
            made = [
                batch.column("doc"),
                pa.array(rows["f"], pa.int64()),
                pa.array(rows["n"], pa.int64()),
                pa.array(rows["bits"], pa.binary()),
                pa.array(rows["tokens"], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(made, ["doc", "f", "n", "bits", "tokens"])

    return docs.mapInArrow(run, f"doc {kind}, f long, n long, bits binary, tokens array<long>")


def least_overlap_of_equal(size: int, percent: int = LINK_PERCENT) -> int:
    """The least overlap of a set of `size` with any set that it links with."""
    return -(-percent * size // 100)


def _overlap(percent: int) -> tuple[str, str]:
    """SQL of least_overlap(na, nb), and of the prefix tokens that linked sets of these sizes, na >= nb, share."""
    least = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"
    return least, f"({least} - ({percent} * na + 99) div 100 + 1)"


def _pairs(few: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and shared prefix tokens do not rule out, na >= nb.

    A token has few sets here, so the join by token makes a bounded number of pairs for
    each row. Of two linked sets, the prefix that ends first in the global order holds
    all but least_overlap(size) - 1 of its set's tokens, so least_overlap(na, nb) -
    least_overlap_of_equal(na) + 1 of them at least are in both prefixes. The first common
    token has no more than n - least_overlap(na, nb) tokens of its set before it. Tokens
    of many sets are not seen here; a pair may share as many as the set with fewer has.
    """
    least, shared = _overlap(percent)
    known = few.join(crowded.select("f", "k"), "f", "left").select("t", "f", "n", "i", F.coalesce("k", F.lit(0)).alias("k"))
    left, right = known.toDF("t", "a", "na", "ia", "ka"), known.toDF("t", "b", "nb", "ib", "kb")
    fitting = F.expr(f"(nb < na or nb = na and b < a) and 100 * nb >= {percent} * na")
    met = left.join(right, "t").filter(fitting).withColumn("early", F.expr(f"ia <= na - {least} and ib <= nb - {least}"))
    counted = met.groupBy("a", "b", "na", "nb", F.least("ka", "kb").alias("k")).agg(
        F.count("*").alias("both"), F.max("early").alias("early")
    )
    return counted.filter(F.expr(f"both + k >= {shared} and (early or k > 0)")).select("a", "b")


def _hub_pairs(many: DataFrame) -> DataFrame:
    """Pairs (a, b) of a hub and each set with the same least hash of tokens of many sets, HUBS times over."""
    least = many.groupBy("f").agg(*(F.min(F.xxhash64("t", F.lit(k))).alias(f"h{k}") for k in range(HUBS)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in range(HUBS))))
    dealt = least.select("f", each.alias("x")).select("f", "x.k", "x.h")
    hubs = dealt.groupBy("k", "h").agg(F.min(F.struct(F.xxhash64("f", "k").alias("o"), F.col("f").alias("a"))).alias("x"))
    return dealt.join(hubs.select("k", "h", "x.a"), ["k", "h"]).filter("a <> f").select("a", F.col("f").alias("b"))


def _blocks(placed: DataFrame, block_sets: int) -> DataFrame:
    """Blocks of sets (t, f, root) with a common token, and each pair of blocks as a bundle.

    Sets of the token's largest root, if these are more than a block, meet only the others.
    """
    counted = placed.groupBy("t", "root").agg(F.count("*").alias("c"))
    sizes = counted.groupBy("t").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("x"))
    parts = sizes.filter("x.c < m").selectExpr("t", f"if(x.c > {block_sets}, x.c, 0) most", "x.root main", "m").selectExpr(
        "t", "main", f"cast(ceil(most / {block_sets}) as int) mains", f"cast(ceil((m - most) / {block_sets}) as int) others"
    )
    dealt = placed.join(parts, "t").withColumn("of_main", F.expr("mains > 0 and root = main"))
    dealt = dealt.withColumn("i", F.expr("cast(pmod(xxhash64(f, t), if(of_main, mains, others)) as int)"))
    among = dealt.filter("not of_main").withColumn("j", F.expr("explode(sequence(0, others - 1))"))
    across = dealt.filter("mains > 0").withColumn("j", F.expr("explode(sequence(0, if(of_main, others, mains) - 1))"))
    return among.selectExpr(
        "concat_ws('/', t, least(i, j), greatest(i, j)) bundle", *placed.columns, "i <= j probe", "i >= j stored"
    ).union(
        across.selectExpr(
            "concat_ws('/', t, 'main', if(of_main, i, j), if(of_main, j, i)) bundle",
            *placed.columns, "of_main probe", "not of_main stored",
        )
    )


def _alike(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of positions (a, b) the parity bits do not rule out."""
    near, lengths = np.zeros(len(a), bool), np.array([len(x) for x in bits])
    for of_a, of_b in {*zip(lengths[a].tolist(), lengths[b].tolist(), strict=True)}:
        at = np.flatnonzero((lengths[a] == of_a) & (lengths[b] == of_b))
        for part in np.split(at, range(PAIRS_AT_ONCE, len(at), PAIRS_AT_ONCE)):
            x, y = (np.frombuffer(b"".join([bits[k] for k in c[part]]), np.uint64).reshape(len(part), -1) for c in (a, b))
            while x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            total = sizes[a[part]] + sizes[b[part]]
            least = least_overlap(sizes[a[part]], sizes[b[part]], percent)
            near[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= total - 2 * least
    return near


def near_prefixes(
    token: int, sizes: np.ndarray, roots: np.ndarray, probe: np.ndarray, stored: np.ndarray,
    prefixes: list[np.ndarray], percent: int = LINK_PERCENT,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions (larger, smaller) of pairs of sets whose first common prefix token by value is `token`.

    Left out are pairs that are connected already, or that sizes or the number of common
    prefix tokens rule out.
    """
    values, columns, counts = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    places = np.cumsum(counts > 1) - 1  # tokens of one set only count for no pair
    rows = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])[counts[columns] > 1]
    columns = places[columns[counts[columns] > 1]]
    values = values[counts > 1]
    least = np.minimum(sizes[:, None], sizes[None, :])
    most = np.maximum(sizes[:, None], sizes[None, :])
    fit = (100 * least >= percent * most) & (roots[:, None] != roots[None, :])
    fit &= (probe[:, None] & stored[None, :]) | (stored[:, None] & probe[None, :])
    both, before = np.zeros(fit.shape, np.float32), int(np.searchsorted(values, token))
    cuts = sorted({*range(0, len(values), TOKENS_AT_ONCE), before, len(values)})
    for start, end in zip(cuts, cuts[1:], strict=False):
        of = (columns >= start) & (columns < end)
        holds = np.zeros((len(prefixes), end - start), np.float32)
        holds[rows[of], columns[of] - start] = 1
        both += holds @ holds.T
        if end == before:
            fit &= both == 0
    fit &= both >= least_overlap(least, most, percent) - least_overlap_of_equal(most, percent) + 1
    a, b = np.nonzero(np.triu(fit, 1))
    swap = sizes[a] < sizes[b]
    return np.where(swap, b, a), np.where(swap, a, b)


def _crowded_pairs(many: DataFrame, nodes: DataFrame, roots: DataFrame, block_sets: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that share tokens of many sets, are not connected yet and not ruled out by prefixes and bits."""
    placed = many.select("t", "f", "n").join(roots.withColumnRenamed("u", "f"), "f", "left")
    placed = placed.withColumn("root", F.coalesce("root", "f"))
    rows = _blocks(placed, block_sets).join(nodes.select("f", "tokens", "bits"), "f")

    def pairs(bundle: list[tuple]) -> pa.RecordBatch:
        if len(bundle) < 2:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        token, f, sizes, roots, probe, stored, bits, prefixes = zip(*bundle, strict=True)
        sizes = np.array(sizes)
        a, b = near_prefixes(
            token[0], sizes, np.array(roots), np.array(probe), np.array(stored), list(prefixes), percent
        )
        near = _alike(a, b, sizes, bits, percent)
        return pa.RecordBatch.from_arrays([pa.array(np.array(f)[x[near]], pa.int64()) for x in (a, b)], ["a", "b"])

    return _by_bundle(rows, ["t", "f", "n", "root", "probe", "stored", "bits"], "tokens", pairs)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity bits do not rule out."""
    bits = nodes.select("f", "n", "bits")
    sized = pairs.join(bits.toDF("a", "na", "xa"), "a").join(bits.toDF("b", "nb", "xb"), "b")
    held = sized.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches):
        for batch in _parts(batches):
            columns = [batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")]
            near = [
                _differ(xa, xb) <= na + nb - 2 * least_overlap(na, nb, percent)
                for na, nb, xa, xb in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return held.mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame, wanted: Broadcast, n: int) -> DataFrame:
    """(f, members) of the wanted sets, and of a few others that share buckets with them."""

    def run(batches):
        flags = wanted.value
        for batch in _parts(batches):
            batch = batch.filter(pa.array(flags[_buckets(batch.column("h").to_numpy())]))
            sets = [shingle_set(text, n) for text in binary(batch, "text")]
            f = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], np.int64)
            kept = np.flatnonzero(flags[_buckets(f)])
            made = pa.array([sets[k].view(np.int64) for k in kept], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(f[kept]), made], ["f", "members"])

    return rows.select(F.xxhash64("doc").alias("h"), "text").mapInArrow(run, "f long, members array<long>")


def _links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, n: int, percent: int, block_sets: int) -> DataFrame:
    """Links (a, b) among the pairs, no more than connect them: each a meets its partners in a tree."""
    near = staged(_near(pairs.distinct(), nodes, percent), "pairs")
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / block_sets).alias("parts")).filter("parts > 1")
    dealt = near.join(parts, "a", "left").withColumn("i", F.expr("pmod(xxhash64(b), coalesce(parts, 1))"))
    named = dealt.select(F.concat_ws("/", "a", "i").alias("bundle"), "a", "b")
    partner = named.select("bundle", F.col("b").alias("f"), F.lit(False).alias("probe"), F.lit(True).alias("stored"))
    own = named.select("bundle", F.col("a").alias("f"), F.lit(True).alias("probe"), F.lit(False).alias("stored"))
    bundles = partner.union(own.distinct())
    wanted = bundles.select("f").distinct().join(nodes.select("f", "doc"), "f")
    hashes = wanted.select(F.explode(F.array("f", F.xxhash64("doc"))).alias("h"))
    flags = _bucket_counts(hashes, lambda batch: batch.column("h").to_numpy()) > 0
    sets = _sets(rows, rows.sparkSession.sparkContext.broadcast(flags), n)
    return staged(_joined(bundles.join(sets.dropDuplicates(["f"]), "f"), percent).distinct(), "links")


def linked_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = SHINGLE_WORDS,
    paired: int = PAIRED,
    block_sets: int = BLOCK_SETS,
    percent: int = LINK_PERCENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest linked id.

    Sets of shingles of n words link when 100 * intersection >= percent * union.

    Equal sets are one node from the start, so copies are never compared. Shingles are
    ordered by how many documents have their hash value (counted over all documents, in
    an array of fixed size) and then by hash; sets that link share one of the first few
    in that order. Tokens of one set only are dropped. Up to `paired` sets with a common
    token are paired, if their sizes, shared prefix tokens and parity bits allow a link,
    and each set meets its partners in one tree. Sets with a token of more sets first
    meet a few hubs in this way; what is not connected then is dealt into blocks by
    token, and prefixes and bits are compared in every pair of blocks by itself, so that
    no task holds more than two blocks. The pairs they leave meet in trees like the others.
    Sets travel only to trees, and only links that connect are returned. All of it is exact
    for 64-bit hashes of shingles and sets.

    Rows without words, with null or empty text, have no shingles and link with nothing.
    Rows with a null id take no part and keep a null component. Repeated ids are texts of
    their own that share an id; repeated rows have equal results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def shingles(batch):
        return np.concatenate([np.empty(0, np.uint64), *(shingle_set(text, n) for text in binary(batch, "text"))])

    counts = spark.sparkContext.broadcast(_bucket_counts(rows.select("text"), shingles))
    every = staged(_nodes_and_tokens(rows, n, percent, counts), "sets")
    firsts = (F.first(c).alias(c) for c in ("n", "bits", "tokens"))
    some = every.filter("n > 0 and doc is not null")
    nodes = staged(some.groupBy("f").agg(F.min("doc").alias("doc"), *firsts), "nodes")
    tokens = nodes.select("f", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("i", "t"))
    sizes = tokens.groupBy("t").agg(F.count("*").alias("m")).filter("m > 1")
    grouped = staged(tokens.join(sizes, "t"), "groups")
    many = grouped.filter(F.col("m") > paired)
    crowded = many.groupBy("f").agg(F.count("*").alias("k"))
    pairs = _pairs(grouped.filter(F.col("m") <= paired), crowded, percent)
    links = _links(pairs.union(_hub_pairs(many)), rows, nodes, n, percent, block_sets)
    if many.limit(1).count():
        roots = components(links.toDF("u", "v"))
        more = _links(_crowded_pairs(many, nodes, roots, block_sets, percent), rows, nodes, n, percent, block_sets)
        links = roots.toDF("a", "b").union(more)
    return _labelled(every, nodes, links, id_col)


def _by_bundle(rows: DataFrame, columns: list[str], listed: str, made: Callable[[list[tuple]], pa.RecordBatch]) -> DataFrame:
    """What `made` makes of each bundle's rows (columns, the list as an array), one bundle after the other."""

    def run(batches):
        name, bundle = None, []
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in ("bundle", *columns)]
            lists = batch.column(listed)
            for k, row in enumerate(zip(*values, strict=True)):
                if row[0] != name:
                    if bundle:
                        yield made(bundle)
                    name, bundle = row[0], []
                bundle.append((*row[1:], lists[k].values.to_numpy(zero_copy_only=False).copy()))
        if bundle:
            yield made(bundle)

    dealt = rows.select("bundle", *columns, listed).repartition("bundle").sortWithinPartitions("bundle", "f")
    return dealt.mapInArrow(run, "a long, b long")


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each bundle, which a task reads one after the other."""

    def links(bundle: list[tuple]) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        if len(bundle) > 1:
            f, probe, stored, members = zip(*bundle, strict=True)
            sets = [m.view(np.uint64) for m in members]
            found = link_forest(np.array(f), sets, np.array(probe), np.array(stored), percent)
        columns = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return _by_bundle(rows, ["f", "probe", "stored"], "members", links)


def _labelled(every: DataFrame, nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """The smallest id of each node's component, given back to all rows of its set."""
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = nodes.select("f", "doc").join(roots.withColumnRenamed("u", "f"), "f", "left").withColumn(
        "root", F.coalesce("root", "f")
    )
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = rooted.join(least, "root").select("f", "component_id")
    found = every.join(labels, "f", "left")
    return found.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc")).otherwise(F.col("doc")).alias("component_id"),
    )
