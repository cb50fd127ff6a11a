"""N-gram Jaccard join: documents whose word shingles have a similarity of 0.8 or more.

Exact, without pairs of all documents or of all members of a group.

1. Batches of documents (of bounded bytes) ask for the frequency of their shingles in the lower
   ``LOW`` share of the hash space (a packed exchange).  In the order "rare
   ones of that share first, then the rest", two similar documents have a
   common shingle in the first ``n - ceil(0.8 n) + 1``.  A document of which
   these all occur once is linked with nothing and is done; the others keep
   their sets.  Shingles that many documents share come last in this order.
2. Rows of equal sets form a class; its first row (by doc_id, then by the hash of
   the text) stands for it, and the hash of the set names it.
3. Classes with an equal minimum of one of ``KEYS`` hash functions meet in
   blocks (of at most about ``BLOCK`` members; which block doesn't matter
   here).  In a block a signature tree finds the pairs that can be similar;
   they are checked exactly, unless linked by then.  Components of these links
   hold nearly all groups of near copies.
4. What is left are links between different components.  Those that have a
   common shingle of step 1 in members of about the same size (each size is in
   two classes of ``SIZE_STEP``, so what can be similar meets in one) are
   compared as nodes of a signature tree (OR and AND of all members' bitmaps,
   range of sizes); of the pairs of components that remain, members are compared
   through signature trees, in blocks of the larger one's members by the
   partners' members.

Shingles and sets are told apart by hashes of 64 and 128 bits.

Result: one row for each document with its number of shingles and the least
doc_id that links reach.  ``first`` is true for one document of each component
(equal rows together) and for those that are linked with nothing.

Defined cases: null and empty texts have no shingles and are linked with
nothing; texts of fewer than five words are one shingle; rows without doc_id
take no part and get a null component; rows of one doc_id with different texts
are documents of their own; repeated rows each get the result of their doc_id
and text; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packed
from . import signature_tree as tree
from .components import components
from .grouped import by_group
from .session import batches, bounded_batches, called, cut, streamed

WORDS = 5
LOW = 0.27
LOW_END = np.uint64(int(LOW * 2**64))
KEYS = 3
BLOCK = 512
TREE_BLOCK = 4096
SLICE = 1 << 19
SIZE_STEP = 1.26  # two similar sets differ in size by 1.25 at most
SUMMARY_WORDS = 512
SET = "doc_id long, text_hash long, n long, h1 long, h2 long, prefix binary, tokens binary"


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and where each text's begin (and the end)."""
    low = K.LOWER[buf]
    start, end, doc = K.word_spans(low, off)
    h = K.Hasher(low)(start, end)
    texts = len(off) - 1
    n = np.bincount(doc, minlength=texts)
    full = len(h) - WORDS + 1
    if full > 0:
        s = np.zeros(full, np.uint64)
        for i in range(WORDS):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + full]
        ok = doc[:full] == doc[WORDS - 1 :]
        s, of = K.mix(s[ok]), doc[:full][ok]
    else:
        s, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    few = np.flatnonzero((n > 0) & (n < WORDS))
    short = np.zeros(len(few), np.uint64)
    for k, t in enumerate(few.tolist()):
        v = int(n[t])
        for x in h[first[t] : first[t] + n[t]].tolist():
            v = (v * 0xC2B2AE3D27D4EB4F + x) & (2**64 - 1)
        short[k] = v
    s, of = np.concatenate([s, K.mix(short)]), np.concatenate([of, few])
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[new], of[new]
    return s, np.searchsorted(of, np.arange(texts + 1))


def _ask(buckets: int):
    def asked(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for _, _, buf, off in K.slices(table.column("text"), SLICE):
            s, _ = shingles(buf, off)
            u, n = np.unique(s[s < LOW_END], return_counts=True)
            keys.append(u)
            counts.append(n)
        if not keys:
            return packed.requests(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), buckets)
        u, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, np.concatenate(counts), minlength=len(u)).astype(np.int64)
        return packed.requests(table.column("batch")[0].as_py(), u, n, buckets)

    def run(table: pa.Table) -> pa.Table:
        return called(asked, table)

    return run


def _repeated(keys: np.ndarray, counts: np.ndarray, row: np.ndarray):
    distinct, of = np.unique(keys, return_inverse=True)
    total = np.bincount(of, counts, minlength=len(distinct)).astype(np.int64)[of]
    keep = np.flatnonzero(total > 1)
    return keep, total[keep], None


def _sets(left: pa.Table, right: pa.Table) -> pa.Table:
    return called(_sets_of, left, right)


def _sets_of(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sizes and fingerprints of all texts; sets and the prefix's repeated shingles of those with any."""
    known, freq = packed.replies(right)
    size, h1, h2, prefix, sets = [], [], [], [], []
    for _, _, buf, off in K.slices(left.column("text"), SLICE):
        s, at = shingles(buf, off)
        n = np.diff(at)
        size.append(n)
        of = np.repeat(np.arange(len(n)), n)
        for out, seed in ((h1, 0x165667B19E3779F9), (h2, 0x27D4EB2F165667C5)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(s ^ np.uint64(seed)), dtype=np.uint64)])
            out.append(sums[at[1:]] - sums[at[:-1]])
        low = s < LOW_END
        df = np.zeros(len(s), np.int64)
        df[low] = packed.found(known, freq, s[low])
        alone = low & (df == 0)
        need = n - (8 * n + 9) // 10 + 1
        open_places = np.where(n > 0, need - np.bincount(of[alone], minlength=len(n)), 0)
        for t in range(len(n)):
            if open_places[t] <= 0:
                prefix.append(None)
                sets.append(None)
                continue
            mine = slice(at[t], at[t + 1])
            rest = np.flatnonzero(~alone[mine])
            rank = np.where(low[mine], df[mine], np.iinfo(np.int64).max)[rest]
            chosen = s[mine][rest[np.lexsort((s[mine][rest], rank))[: open_places[t]]]]
            prefix.append(chosen.tobytes())
            sets.append(s[mine].tobytes())
    whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (size, h1, h2)]
    return pa.table({"doc_id": left.column("doc_id"), "text_hash": left.column("text_hash"), "n": pa.array(whole[0].astype(np.int64)), "h1": pa.array(whole[1].view(np.int64)), "h2": pa.array(whole[2].view(np.int64)), "prefix": pa.array(prefix, pa.binary()), "tokens": pa.array(sets, pa.binary())})


def _u64(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _first_of_equal(batches):
    """Rows of a stream sorted by node, without those that repeat the node before."""
    last = None
    for batch in batches:
        node = batch.column("node").to_numpy()
        if len(node):
            new = np.r_[last is None or node[0] != last, node[1:] != node[:-1]]
            last = node[-1]
            yield batch.filter(pa.array(new))


def _min_keys(batches):
    """node and key for the minimum of each hash function."""
    for batch in batches:
        node, key = [], []
        for r, t in zip(batch.column("node").to_pylist(), batch.column("tokens"), strict=True):
            s = _u64(t)
            for k in range(KEYS):
                node.append(r)
                key.append(int((K.mix(s ^ np.uint64(0x9FB21C651E98DF25 * (k + 1) & (2**64 - 1))).min() ^ np.uint64(k)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(key, pa.int64())], ["node", "key"])


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _pairs(sets: list[np.ndarray]):
    """Pairs that may be similar: all of one leaf, or what a tree of leaves leaves over."""
    if len(sets) <= tree.FANOUT:
        yield np.triu_indices(len(sets), 1)
    else:
        yield from tree.pairs(_leaves(sets))


def _leaves(sets: list[np.ndarray]) -> tree.Nodes:
    n = np.array([len(s) for s in sets])
    words = tree.words_for(int(n.max()))
    bits = np.stack([tree.bitmap(s, words) for s in sets])
    return tree.Nodes(bits, bits, n, n)


def _block_links(table: pa.Table) -> list:
    """Members of a block that are similar to others of it, with the least member they are connected with."""
    sets = [_u64(t) for t in table.column("tokens")]
    nodes = table.column("node").to_numpy()
    union = Union(len(sets))
    for xs, ys in _pairs(sets):
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            if union.root(x) != union.root(y) and tree.similar(sets[x], sets[y]):
                union.join(x, y)
    root = np.array([union.root(i) for i in range(len(sets))])
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    linked = np.bincount(root, minlength=len(sets))[root] > 1
    return [nodes[linked], least[root][linked]]


SUMMARY = ["comp", "low", "high", "size", "either", "every"]
SUMMARY_TYPES = "comp long, low long, high long, size long, either binary, every binary"


def _combined(comp: int, low, high, size, either: list[np.ndarray], every: list[np.ndarray]) -> list:
    words = min(len(b) for b in (*either, *every))
    both = (np.bitwise_or.reduce([tree.folded(b, words) for b in either]), np.bitwise_and.reduce([tree.folded(b, words) for b in every]))
    return [[comp], [int(np.min(low))], [int(np.max(high))], [int(np.sum(size))], *([b.tobytes()] for b in both)]


def _summaries(batches):
    """Size range, number and OR and AND of the bitmaps of each component's members in a batch."""
    for batch in batches:
        comp, n = batch.column("comp").to_numpy(), batch.column("n").to_numpy()
        bits = [tree.bitmap(_u64(t), tree.words_for(int(k), SUMMARY_WORDS)) for t, k in zip(batch.column("tokens"), n, strict=True)]
        order = np.argsort(comp, kind="stable")
        out = [_combined(int(comp[at[0]]), n[at], n[at], np.ones(len(at)), b := [bits[i] for i in at], b) for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1) if len(at)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i][0] for o in out], pa.int64() if i < 4 else pa.binary()) for i in range(6)], SUMMARY)


def _summary(table: pa.Table) -> list:
    """One summary of several of one component."""
    either, every = ([_u64(x) for x in table.column(c)] for c in ("either", "every"))
    return _combined(table.column("comp")[0].as_py(), *(table.column(c).to_numpy() for c in ("low", "high", "size")), either, every)


def _merged(table: pa.Table) -> pa.Table:
    return pa.table([pa.array(x, pa.int64() if i < 4 else pa.binary()) for i, x in enumerate(_summary(table))], SUMMARY)


def _candidates(table: pa.Table) -> list:
    """Pairs of components of one shingle that a signature tree can't rule out, the larger one first, with their sizes."""
    maps = [[_u64(x) for x in table.column(c)] for c in ("either", "every")]
    words = min(len(b) for b in maps[0])
    either, every = (np.stack([tree.folded(b, words) for b in m]) for m in maps)
    comp, size = table.column("comp").to_numpy(), table.column("size").to_numpy()
    part, (i, j) = table.column("part").to_numpy(), (table.column(c)[0].as_py() for c in ("i", "j"))
    nodes = tree.Nodes(either, every, table.column("low").to_numpy(), table.column("high").to_numpy())
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in tree.pairs(nodes):
        ok = (comp[p] != comp[q]) & ((part[p] != part[q]) | (i == j))
        x.append(p[ok])
        y.append(q[ok])
    x, y = np.concatenate(x), np.concatenate(y)
    swap = (size[x] < size[y]) | (size[x] == size[y]) & (comp[x] > comp[y])
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return [comp[x], comp[y], size[x], size[y]]


def _cross_links(table: pa.Table) -> list:
    """Which partner components have a member similar to one of the larger component's members here."""
    other = table.column("other").to_numpy()
    big = table.column("big")[0].as_py()
    sets = [_u64(t) for t in table.column("tokens")]
    linked: set[int] = set()
    for xs, ys in _pairs(sets):
        ok = (other[xs] == big) != (other[ys] == big)
        for x, y in zip(xs[ok].tolist(), ys[ok].tolist(), strict=True):
            o = int(other[x] if other[y] == big else other[y])
            if o not in linked and tree.similar(sets[x], sets[y]):
                linked.add(o)
    return [np.full(len(linked), big), np.array(sorted(linked), np.int64)]


def _spread(count, size: int):
    """Number of parts for so many rows."""
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("long")


def _one_of_each(rows: DataFrame, key: str, member: str, count: str) -> DataFrame:
    """Keys with two members or more and their number; of keys with the same members one will do."""
    h = F.xxhash64(member, F.lit("one")), F.xxhash64(member, F.lit("two"))
    groups = rows.groupBy(key).agg(F.count("*").alias(count), F.bit_xor(h[0]).alias("s1"), F.bit_xor(h[1]).alias("s2")).where(F.col(count) > 1)
    return groups.groupBy("s1", "s2", count).agg(F.min(key).alias(key)).select(key, count)


def _part(column: str, parts):
    return F.pmod(F.xxhash64(column, F.lit("part")), parts)


def _numbers(parts):
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def _near_copies(reps: DataFrame) -> DataFrame:
    """node, comp: components of the links found in blocks of classes with an equal minimum."""
    keys = reps.select("node", "tokens").mapInArrow(streamed(_min_keys), "node long, key long").distinct()
    shared = _one_of_each(keys, "key", "node", "members")
    placed = keys.join(shared, "key").select("node", "key", _part("node", _spread(F.col("members"), BLOCK)).alias("part"))
    links = by_group(placed.join(reps.select("node", "tokens"), "node"), ["key", "part"], _block_links, ["a", "b"])
    return cut(components(reps.select("node"), links, stars=True))


def _left_over(reps: DataFrame, near: DataFrame) -> DataFrame:
    """a, b: links between the components of near."""
    known = reps.select("node", "n", "prefix").join(near, "node")
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZE_STEP)))
    token = F.expr("transform(sequence(1, int(octet_length(prefix) / 8)), i -> xxhash64(substring(prefix, 8 * i - 7, 8), size))")
    sized = known.select("comp", "prefix", F.explode(F.array(size, size + 1)).alias("size"))
    by_token = sized.select("comp", F.explode(token).alias("token")).distinct()
    meets = cut(by_token.join(_one_of_each(by_token, "token", "comp", "comps"), "token"))
    members = near.join(meets.select("comp").distinct(), "comp", "left_semi")
    parts = reps.select("node", "n", "tokens").join(members, "node").select("comp", "n", "tokens").mapInArrow(streamed(_summaries), SUMMARY_TYPES)
    summary = by_group(parts, ["comp"], _summary, SUMMARY, ("either", "every"), _merged)
    spread = _spread(F.col("comps"), TREE_BLOCK)
    placed = meets.withColumn("part", _part("comp", spread)).withColumn("q", _numbers(spread))
    placed = placed.select("token", "comp", "part", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"))
    pairs = cut(by_group(placed.join(summary, "comp"), ["token", "i", "j"], _candidates, ["big", "other", "size", "partner"]).distinct())
    grid = pairs.groupBy("big").agg(_spread(F.max("size"), BLOCK).alias("rows"), _spread(F.sum("partner"), BLOCK).alias("columns"))
    one = near.join(grid, near.comp == grid.big).select("node", "big", F.col("big").alias("other"), _part("node", F.col("rows")).alias("i"), _numbers(F.col("columns")).alias("j"))
    two = pairs.select("big", "other").join(grid, "big").join(near.withColumnRenamed("comp", "other"), "other")
    two = two.select("node", "big", "other", _numbers(F.col("rows")).alias("i"), _part("node", F.col("columns")).alias("j"))
    return by_group(one.unionByName(two).join(reps.select("node", "tokens"), "node"), ["big", "i", "j"], _cross_links, ["a", "b"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, first of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("batch")), F.lit(n)))
    by_batch = rows.groupBy("batch")
    asked = by_batch.applyInArrow(_ask(n), packed.REQUEST)
    answers = packed.answered(asked, _repeated)
    sets = cut(by_batch.cogroup(answers.groupBy("batch")).applyInArrow(_sets, SET))

    open_sets = sets.where("prefix is not null and doc_id is not null")
    classes = open_sets.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    heads = classes.select(F.col("h1").alias("node"), F.col("head.doc_id").alias("d"), F.col("head.text_hash").alias("t"))
    same = (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("h1") == F.col("node"))
    # sorted by the join, so rows that repeat a class's first row lie together
    reps = cut(open_sets.select("doc_id", "text_hash", "h1", "n", "prefix", "tokens").join(heads.hint("merge"), same).select("node", "n", "prefix", "tokens").mapInArrow(streamed(_first_of_equal), "node long, n long, prefix binary, tokens binary"))
    near = _near_copies(reps)
    joined = components(near.select(F.col("comp").alias("node")), _left_over(reps, near))

    final = near.join(joined.select(F.col("node").alias("c"), F.col("comp").alias("whole")), F.col("comp") == F.col("c")).select("node", "whole")
    of_class = cut(classes.join(final, F.col("h1") == F.col("node")).select("h1", "h2", "head", "whole"))
    whole = of_class.groupBy("whole").agg(F.min("head").alias("leader"))
    of_class = of_class.join(whole, "whole").select("h1", "h2", "leader")
    leads = F.coalesce((F.col("doc_id") == F.col("leader.doc_id")) & (F.col("text_hash") == F.col("leader.text_hash")), F.lit(True))
    alone = sets.where("prefix is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("first"))
    found = open_sets.join(of_class, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("leader.doc_id").alias("component_id"), "text_hash", leads.alias("first"))
    return alone.unionByName(found)
