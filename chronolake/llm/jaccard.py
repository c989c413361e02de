"""N-gram Jaccard join: which documents share at least num/den of their word shingles.

1. Rows with equal sets are one node from the start (a digest, combined map-side); the text
   that stands for it is that of its least (doc_id, hash).
2. Dealing. Nodes are dealt out to traversal tasks so that two that link always meet. Shingles
   fall into k parts by their hashes. Two linked sets of sizes up to a and b differ in at most
   h = (a + b)(1 - t)/(1 + t) shingles, so that at least k - h parts are equal on both sides;
   k is h + 1 and some slack, by the size range of the smaller set. A task writes the hash of
   each part that is not empty once per block of its rows, so none is hot in the shuffle. Nodes
   that share fewer parts with all others together than a link takes are out; the rest are
   tied by their parts, and the components of these ties are clusters. Nothing is lost by it.
   A cluster of many blocks is taken apart again: two sets that link share need parts, so they
   still meet where each leaves out the need - 1 of its parts that most sets of it hold, which
   are those of passages that unlike texts have in common.
3. Candidates. A cluster is joined with itself by signature trees: sets in the order of size
   are leaves, and nodes above them hold the OR of their token bitmaps and their size range.
   Two trees are traversed against each other, level by level, and a pair of nodes is
   given up where sizes or the largest possible overlap exclude a link. The pairs of sets that
   come out are counted exactly. Clusters beyond CLUSTER_SHINGLES are dealt out in blocks, a
   pair of blocks to a task.

jaccard_join finds every link and so counts a document's links; in a cluster it costs in proportion
to the pairs of different sets that the trees do not exclude. jaccard_rows finds components: pairs
that are one component already are skipped, and in clusters of many blocks a first round of
neighbouring blocks finds the main component, whose members are then compared with the others
only. Shingles are compared by 64-bit hashes. Only the texts of clustered nodes are turned into
sets for step 3.

Cases: null or empty text, or no word: n_shingles 0, linked with nothing, a component of its
own; fewer words than a shingle: the whole sequence is one; null doc_id: linked with nothing,
null component; repeated rows: equal sets, linked; several texts under one doc_id are
linked each by itself, so that their rows may have different components; empty table: empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, small_batches, utf8
from .graph import Forest, components

BLOCK_TOKENS = 2_000_000
CACHE_WORDS = 400_000
#: Shingles of a cluster that one side of a task compares; larger clusters are split into blocks.
CLUSTER_SHINGLES = 40_000
#: Blocks of a cluster, and what a block has at most, where that takes more of them: shingles and words of bitmaps.
BLOCKS, BLOCK_SHINGLES = 12, 1_000_000
#: Bits of a set's signature, children of a tree node, and node pairs that are looked at at a time.
BITS, FAN, PAIRS = 4096, 4, 20_000
#: A size range goes from L to about L / t**RANGE.
RANGE = 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


class Shingler:
    """Sorted distinct shingle hashes of texts in UTF-8; A-Z are lowered, words end at ASCII white space."""

    def __init__(self, words: int) -> None:
        self.k, self.hashes = words, _WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.hashes) > CACHE_WORDS:
            self.hashes = _WordHashes()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.k, len(h))
        s = _mix(h[: len(h) - k + 1] + np.uint64(k))
        for i in range(1, k):
            s = _mix(s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i])
        return np.unique(s)


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _blocks(batches: Iterable[pa.RecordBatch], shingler: Shingler) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """(doc_ids, hashes of texts, sets) of about BLOCK_TOKENS shingles."""
    ids, hashes, sets, size = [], [], [], 0
    for b in batches:
        for i, text, h in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "h"))):
            s = shingler(text)
            ids.append(i)
            hashes.append(h)
            sets.append(s)
            size += len(s)
            if size >= BLOCK_TOKENS:
                yield ids, hashes, sets
                ids, hashes, sets, size = [], [], [], 0
    if ids:
        yield ids, hashes, sets


def _source(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"), text_hash().alias("h"))


def text_hash() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(utf8())


def _key(digest: bytes) -> int:
    """62 bits of a digest; the part hashes of a set are found by them."""
    return int.from_bytes(digest[:8], "little", signed=True) >> 2


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, n_shingles, digest, key)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, sets in _blocks(batches, Shingler(words)):
            digests = [_digest(s) if len(s) else None for s in sets]
            keys = [None if d is None else _key(d) for d in digests]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64())], ["doc_id", "h", "n_shingles", "digest", "key"])

    return _source(docs).mapInArrow(run, "doc_id long, h long, n_shingles long, digest binary, key long")


class SizeRanges:
    """Ranges of set sizes that follow each other; a set links into its own range and those next to it alone."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.first = num, den, [1]

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            low = self.first[-1]
            self.first.append(max(low + 1, low * self.den**RANGE // self.num**RANGE))
        return bisect_right(self.first, n) - 1

    def probes(self, n: int) -> range:
        """The ranges that the smaller of two linked sets, one of n elements, may be in."""
        return range(self.of(-(-n * self.num // self.den)), self.of(n) + 1)

    def parts(self, at: int) -> tuple[int, int]:
        """(parts, parts that are equal in two linked sets at least) for smaller sets in a range; (0, 0) where only equal sets link."""
        most = self.first[at + 1] - 1
        differ = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        equal = 5 + differ // 6
        return (differ + equal, equal) if differ else (0, 0)


def _probes(keys: list[int], sets: list[np.ndarray], ranges: SizeRanges) -> tuple[np.ndarray, ...]:
    """(part hash, probe) of each part that counts, and (probe, parts that it shares with a partner at least). A probe is a set in one size range."""
    owner, names, parts, equal, salt = [], [], [], [], []
    for i, s in enumerate(sets):
        for at in ranges.probes(len(s)):
            k, e = ranges.parts(at)
            if k:
                owner.append(i)
                names.append(keys[i] << 2 | (at & 3))
                parts.append(k)
                equal.append(e)
                salt.append(at)
    if not owner:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    parts, equal = np.array(parts), np.array(equal)
    begin = np.cumsum(parts) - parts
    size = np.array([len(sets[i]) for i in owner])
    element = np.concatenate([sets[i] for i in owner])
    slot = ((element >> np.uint64(20)) % np.repeat(parts, size).astype(np.uint64)).astype(np.int64) + np.repeat(begin, size)
    total = int(parts.sum())
    mixed = np.zeros(total, np.uint64)
    np.add.at(mixed, slot, _mix(element + np.uint64(1)))
    held = np.bincount(slot, minlength=total) > 0
    probe = np.repeat(np.arange(len(owner)), parts)
    empty = parts - np.bincount(probe[held], minlength=len(owner))
    # an empty part may equal a partner's; it counts as shared by all, and only sets of too many of them are found by these
    need = np.maximum(1, equal - empty)
    held |= (empty >= equal)[probe]
    index = np.arange(total) - np.repeat(begin, parts)
    hashes = _mix(mixed + _mix(np.repeat(np.array(salt), parts).astype(np.uint64) * np.uint64(1 << 32) + index.astype(np.uint64)))
    return hashes[held], probe[held], np.array(names, np.int64), need


def _signatures(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(part, probe, need, found, met): per block of a task, one holder of each part hash (found: if another in the block has it; met null), and for other holders how many parts they share with that one (met; they go anywhere, so part is a hash of the probe)."""
    names = ["part", "probe", "need", "found", "met"]

    def rows(part, probe, need, found, met) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(probe), 100_000):
            c = slice(i, i + 100_000)
            other = pa.nulls(len(probe[c]), pa.int64()) if met is None else pa.array(met[c])
            yield pa.record_batch([pa.array(part[c].view(np.int64)), pa.array(probe[c]), pa.array(need[c].astype(np.int32)), pa.array(found[c].astype(np.int32)), other], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = SizeRanges(num, den)
        for ids, _, sets in _blocks(batches, Shingler(words)):
            first = {_digest(s): s for i, s in zip(ids, sets) if i is not None and len(s)}
            part, of, probe, need = _probes([_key(d) for d in first], list(first.values()), ranges)
            if not len(part):
                continue
            _, same, times = np.unique(part, return_inverse=True, return_counts=True)
            alone = times[same] == 1
            shares = np.bincount(of[~alone], minlength=len(probe))
            order = np.lexsort((-shares[of], part))  # of those that hold a part, the one that shares most stands for them
            part, of, alone = part[order], of[order], alone[order]
            new = np.concatenate([[True], part[1:] != part[:-1]])
            lead = of[np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))]
            yield from rows(part[new], probe[of[new]], need[of[new]], ~alone[new], None)
            tie, found = np.unique(of[~new] * len(probe) + lead[~new], return_counts=True)
            mine = tie // len(probe)
            yield from rows(_mix(probe[mine].astype(np.uint64)), probe[mine], need[mine], found, probe[tie % len(probe)])

    return _source(docs).mapInArrow(run, "part long, probe long, need int, found int, met long")


def _ties(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): ties between the keys of nodes that share enough parts with others to have a partner."""
    rows = _signatures(docs, words, num, den)
    where = Window.partitionBy("part")
    bounds = rows.select("*", F.min("probe").over(where).alias("one"), F.max("probe").over(where).alias("other"))
    shared = bounds.where("met is not null or found > 0 or one < other")
    shared = cut(shared.select("part", "probe", "need", F.greatest("found", F.lit(1)).alias("found"), "met"))
    able = cut(shared.groupBy("probe").agg(F.sum("found").alias("have"), F.max("need").alias("need")).where("have >= need").select("probe"))
    near = cut(shared.where("met is not null").join(able, "probe").select("probe", "met"))
    # those that stand for others are kept too: ties go through them
    kept = able.unionByName(near.select(F.col("met").alias("probe"))).distinct()
    held = cut(shared.where("met is null").join(kept, "probe").select("part", "probe"))
    least = cut(held.groupBy("part").agg(F.min("probe").alias("met")))
    far = held.join(least, "part").where("probe <> met").select("probe", "met")
    ties = cut(near.unionByName(far).select(F.shiftright("probe", 2).alias("a"), F.shiftright("met", 2).alias("b")).where("a <> b").distinct())
    drop(shared, able, near, held, least)
    return ties


class SignatureTree:
    """Sets in the order of size; each level holds, for groups of FAN nodes below, the OR of bitmaps, the size range and the most bit collisions of a set."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        n = np.array([len(s) for s in sets])
        low = np.array([s[0] for s in sets], np.uint64)  # the least hash: similar sets often share it
        self.order = np.lexsort((low, n))
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        twice = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        level = [x[self.order] for x in (bits, n, n, twice)]
        self.levels = [level]
        while len(level[0]) > 1:
            group = np.arange(0, len(level[0]), FAN)
            level = [f.reduceat(x, group) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level)]
            self.levels.append(level)

    def level(self, at: int) -> list[np.ndarray]:
        return self.levels[min(at, len(self.levels) - 1)]


def candidates(one: SignatureTree, two: SignatureTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: places of sets, (in one, in two), that the trees do not exclude from linking. For a tree with itself, each pair once."""
    stack = [(max(len(one.levels), len(two.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        at, a, b = stack.pop()
        if len(a) > PAIRS:
            half = len(a) // 2
            stack += [(at, a[half:], b[half:]), (at, a[:half], b[:half])]
            continue
        (bits, low, high, twice), (bits2, low2, high2, twice2) = one.level(at), two.level(at)
        may = (high[a] * den >= low2[b] * num) & (high2[b] * den >= low[a] * num)
        a, b = a[may], b[may]
        overlap = np.bitwise_count(bits[a] & bits2[b]).sum(1).astype(np.int64) + np.minimum(twice[a], twice2[b])
        most = np.minimum(overlap, np.minimum(high[a], high2[b]))
        may = most * (num + den) >= num * (low[a] + low2[b])
        a, b = a[may], b[may]
        if not at:
            own = a < b if one is two else np.ones(len(a), bool)
            yield one.order[a[own]], two.order[b[own]]
            continue
        below = []
        for tree, x in ((one, a), (two, b)):
            wide, down = len(tree.level(at - 1)[0]), at < len(tree.levels)
            below.append((x[:, None] * FAN + np.arange(FAN) if down else x[:, None], wide))
        (a, wide), (b, wide2) = below
        a, b = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
        there = (a < wide) & (b < wide2) & ((a <= b) if one is two else True)
        if there.any():
            stack.append((at - 1, a[there], b[there]))


def link(sets: list[np.ndarray], num: int, den: int, left: int | None = None, weights: list[int] | None = None) -> tuple[list[int], np.ndarray]:
    """(a member of each set's component, weight of the sets that it links with).

    left: only pairs of one of the first left sets with one of the others are looked at. Without weights,
    links are not counted, and pairs of one component are skipped.
    """
    forest, links = Forest(), np.zeros(len(sets), np.int64)
    n = np.array([len(s) for s in sets])
    if len(sets) > 1 and (left is None or 0 < left < len(sets)):
        one = SignatureTree(sets[:left])
        two = one if left is None else SignatureTree(sets[left:])
        for a, b in candidates(one, two, num, den):
            b = b if left is None else b + left
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            for mine in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1) if len(a) else ():
                i, others = int(a[mine[0]]), b[mine]
                if weights is None:
                    root = forest.root(i)
                    others = others[[forest.root(j) != root for j in others.tolist()]]
                if not len(others):
                    continue
                size = n[others]
                theirs = np.concatenate([sets[j] for j in others])
                at = np.searchsorted(sets[i], theirs)
                same = sets[i][np.minimum(at, n[i] - 1)] == theirs
                common = np.add.reduceat(same.astype(np.int64), np.cumsum(size) - size)
                hit = others[common * (num + den) >= num * (n[i] + size)]
                for j in hit.tolist():
                    forest.tie(i, j)
                if weights is not None and len(hit):
                    links[i] += sum(weights[j] for j in hit.tolist())
                    links[hit] += weights[i]
    return [forest.root(i) for i in range(len(sets))], links


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles), one row per row of nodes (node, digest, lead): the set of the text that stands for the node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sets = [(node, s) for node, digest, text in zip(*(c.to_pylist() for c in b.columns)) if _digest(s := shingler(text)) == digest]
            yield pa.record_batch([pa.array([n for n, _ in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["node", "shingles"])

    def read(some: DataFrame) -> DataFrame:
        some = some.select("node", "digest", F.col("lead.doc_id").alias("doc_id"), F.col("lead.h").alias("h"))
        # both sides grow with the documents: never a broadcast
        return _source(docs).join(some.hint("merge"), ["doc_id", "h"]).select("node", "digest", "text").mapInArrow(run, "node long, shingles binary")

    once = read(nodes.where("lead.copies = 1"))
    repeated = nodes.where("lead.copies > 1")
    return once if repeated.isEmpty() else once.unionByName(read(repeated).groupBy("node").agg(F.first("shingles").alias("shingles")))


def _linker(num: int, den: int, count: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (task, side, node): links the sets of each task; those of side 1, if any, with those of side 0 alone."""

        def flush() -> pa.RecordBatch:
            labels, links = link([np.frombuffer(x, np.uint64) for x in raw], num, den, None if sides is None else sides.count(0), copies if count else None)
            ids = np.array(nodes, np.int64)
            return pa.record_batch([pa.array(ids), pa.array(ids[labels]), pa.array(links)], ["a", "b", "links"])

        task, nodes, raw, copies, sides, paired = None, [], [], [], [], False
        for b in batches:
            for t, cross, side, node, n, s in zip(*(b.column(c).to_pylist() for c in ("task", "cross", "side", "node", "copies", "shingles"))):
                if t != task and nodes:
                    sides = sides if paired else None
                    yield flush()
                    nodes, raw, copies, sides = [], [], [], []
                task, paired = t, cross
                nodes.append(node)
                raw.append(s)
                copies.append(n)
                sides.append(side)
        if nodes:
            sides = sides if paired else None
            yield flush()

    return run


def _compared(dealt: DataFrame, num: int, den: int, count: bool) -> DataFrame:
    """(a, b, links) of rows (task, cross, side, node, copies, shingles): a member b of a's component as far as a task sees it, and how many links it finds."""
    rows = dealt.select("task", "cross", "side", "node", "copies", "shingles").repartition("task").sortWithinPartitions("task", "side", "node")
    return rows.mapInArrow(_linker(num, den, count), "a long, b long, links long")


def _refined(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, cluster): clusters of sets (node, shingles) that are tied by a part which is not among the need - 1 most frequent ones of either; sets without such a tie link with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = SizeRanges(num, den)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                nodes, raw = (c.to_pylist() for c in b.slice(i, 500).columns)
                part, of, probe, need = _probes(nodes, [np.frombuffer(x, np.uint64) for x in raw], ranges)
                yield pa.record_batch([pa.array(part.view(np.int64)), pa.array(probe[of]), pa.array(need[of].astype(np.int32))], ["part", "probe", "need"])

    rows = cut(sets.select("node", "shingles").mapInArrow(run, "part long, probe long, need int"))
    times = rows.groupBy("part").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = cut(rows.join(times, "part"))
    drop(rows)
    of_probe = Window.partitionBy("probe")
    ranked = shared.withColumn("have", F.count(F.lit(1)).over(of_probe)).where("have >= need")
    ranked = ranked.withColumn("place", F.row_number().over(of_probe.orderBy(F.desc("times"), "part")))
    held = cut(ranked.where("place >= need").select("part", "probe"))
    drop(shared)
    least = cut(held.groupBy("part").agg(F.min("probe").alias("met")))
    ties = cut(held.join(least, "part").select(F.shiftright("probe", 2).alias("a"), F.shiftright("met", 2).alias("b")).where("a <> b").distinct())
    drop(held, least)
    return components(ties).select("node", F.col("root").alias("cluster"))


def _n_blocks(n: Column, nodes: Column, size: int) -> Column:
    """Blocks of so many nodes that have n shingles together: of size each while these are few."""
    least = F.ceil((n + nodes * (BITS // 64)) / BLOCK_SHINGLES)
    return F.greatest(F.least(F.ceil(n / size), F.lit(BLOCKS)), F.when(n > size, least).otherwise(1)).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")


def _task(rows: DataFrame, kind: str, low: Column, high: Column, side: Column) -> DataFrame:
    """One row per task; a task has a cluster and two blocks, which are compared with each other, or one, which is with itself."""
    return rows.withColumn("task", F.concat_ws("/", F.lit(kind), "cluster", low, high)).withColumn("side", side.cast("int"))


def _whole(sets: DataFrame) -> DataFrame:
    return _task(sets, "whole", F.lit(0), F.lit(0), F.lit(0)).withColumn("cross", F.lit(False))


def _all_blocks(sets: DataFrame) -> DataFrame:
    """All pairs of the blocks of a cluster, and each block with itself."""
    own = sets.withColumn("own", _block(F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _task(own, "all", F.least("own", "other"), F.greatest("own", "other"), F.col("own") > F.col("other")).withColumn("cross", F.col("own") != F.col("other"))


def _next_blocks(sets: DataFrame) -> DataFrame:
    """Each block with itself and with the next."""
    own = sets.withColumn("own", _block(F.col("blocks")))
    with_next = lambda first, side: _task(own, "next", first, (first + 1) % F.col("blocks"), F.lit(side)).withColumn("cross", F.lit(True))
    before = (F.col("own") + F.col("blocks") - 1) % F.col("blocks")
    return _task(own, "self", F.col("own"), F.col("own"), F.lit(0)).withColumn("cross", F.lit(False)).unionByName(with_next(F.col("own"), 0)).unionByName(with_next(before, 1))


def _rest_blocks(sets: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """What _next_blocks left open: blocks of nodes outside their cluster's main component with each other and with blocks of that."""
    roots = sets.select("node", "cluster", "n").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = cut(roots.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("n")))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("nodes", "root", "n")).alias("main"), F.sum("n").alias("n"), F.sum("nodes").alias("nodes"))
    main = main.where("n > main.n").select("cluster", F.col("main.root").alias("main"), _n_blocks(F.col("main.n"), F.col("main.nodes"), size).alias("main_blocks"), _n_blocks(F.col("n") - F.col("main.n"), F.col("nodes") - F.col("main.nodes"), size).alias("rest"))
    main = cut(main)
    placed = cut(roots.join(main, "cluster").select("node", "main_blocks", "rest", (F.col("root") == F.col("main")).alias("settled")))
    rows = sets.join(placed, "node")
    open_ = rows.where("not settled").withColumn("blocks", F.col("rest"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = open_.withColumn("own", _block(F.col("rest"))).withColumn("other", each("main_blocks"))
    out = _task(out, "main", F.col("own"), F.col("other"), F.lit(0))
    main_rows = rows.where("settled").withColumn("own", _block(F.col("main_blocks"))).withColumn("other", each("rest"))
    main_rows = _task(main_rows, "main", F.col("other"), F.col("own"), F.lit(1))
    return out.unionByName(main_rows).withColumn("cross", F.lit(True)).unionByName(_all_blocks(open_).select(*out.columns, "cross"))


def _nodes(sizes: DataFrame) -> DataFrame:
    """(digest, key, n, copies, lead, node) of each distinct set; lead: the least (doc_id, h) of its texts, and how many rows have that one."""
    texts = sizes.where("digest is not null and doc_id is not null").groupBy("digest", "key", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"))
    found = texts.groupBy("digest", "key").agg(F.max("n").alias("n"), F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "h", "copies")).alias("lead"))
    return cut(found.withColumn("node", F.monotonically_increasing_id()))


def _clustered(docs: DataFrame, words: int, num: int, den: int, cluster_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(named rows, nodes, sets of the clustered nodes): what a traversal of the clusters needs."""
    sizes = cut(_sizes(docs, words))
    nodes = _nodes(sizes)
    named = cut(sizes.join(nodes.select("digest", "node", "lead", "copies"), "digest", "left").drop("digest", "key"))
    drop(sizes)
    clusters = components(_ties(docs, words, num, den)).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    members = cut(nodes.join(clusters, "key").select("node", "digest", "lead", "cluster", "n", "copies"))
    of = lambda some: some.groupBy("cluster").agg(_n_blocks(F.sum("n"), F.count(F.lit(1)), cluster_shingles).alias("blocks"))
    own = _sets(docs, members, words)
    sets = cut(own.join(members.select("node", "cluster", "n", "copies").join(of(members), "cluster"), "node"))
    large = sets.where("blocks > 1").drop("cluster", "blocks")
    if large.isEmpty():
        return named, nodes, sets
    finer = cut(sets.where("blocks > 1").select("node", "n").join(_refined(large, num, den), "node"))
    finer = cut(finer.join(of(finer), "cluster").drop("n"))
    parted = cut(sets.where("blocks = 1").unionByName(large.join(finer, "node")))
    drop(sets)
    return named, nodes, parted


def _first(named: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """named with first, the least (doc_id, h) of each row's component."""
    roots = components(found).join(nodes.select("node", F.struct("lead.doc_id", "lead.h").alias("own")), "node")
    first = cut(roots.groupBy("root").agg(F.min("own").alias("first")))
    out = named.join(roots.join(first, "root").select("node", "first"), "node", "left")
    return out.withColumn("first", F.coalesce("first", F.when(F.col("lead").isNotNull(), F.struct("lead.doc_id", "lead.h"))))


def _component() -> Column:
    return F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(F.col("first.doc_id"), "doc_id"))


def jaccard_rows(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of the component), h (text_hash) and stays, false for a text that is not the least (doc_id, h) of its component."""
    named, nodes, sets = _clustered(docs, words, num, den, cluster_shingles)
    found = cut(_compared(_whole(sets.where("blocks = 1")), num, den, False).where("a <> b"))
    large = sets.where("blocks > 1")
    if not large.isEmpty():
        near = cut(_compared(_next_blocks(large), num, den, False).where("a <> b"))
        # cut: else the forests of components would need a second Python worker in each of these tasks
        rest = cut(_compared(_rest_blocks(large, near, cluster_shingles), num, den, False).where("a <> b"))
        found = found.unionByName(near).unionByName(rest)
    out = _first(named, nodes, found)
    stays = F.col("doc_id").isNull() | F.coalesce((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.h") == F.col("h")), F.lit(True))
    return out.select("doc_id", "n_shingles", _component().alias("component_id"), "h", stays.alias("stays"))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of the component)."""
    return jaccard_rows(docs, words, num, den, cluster_shingles).select("doc_id", "n_shingles", "component_id")


def jaccard_join(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and n_links, the number of other rows that it links with."""
    named, nodes, sets = _clustered(docs, words, num, den, cluster_shingles)
    found = cut(_compared(_whole(sets.where("blocks = 1")).unionByName(_all_blocks(sets.where("blocks > 1")).drop("own", "other")), num, den, True))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    out = _first(named, nodes, found.where("a <> b")).join(links, "node", "left")
    n_links = F.when(F.col("doc_id").isNull() | F.col("lead").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return out.select("doc_id", "n_shingles", _component().alias("component_id"), n_links.cast("long").alias("n_links"))
