"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every string of `length` bytes that also starts earlier is found, over all documents:

1. Buckets. The start p of such a string belongs to the bucket of its anchor, the least hashed
   gram among those inside it: equal strings have equal anchors at equal offsets. Runs of
   starts with one anchor form a segment (about 40 starts in 140 bytes), and a task hands on
   16 bytes of hashes per segment, never the text. Equal segments are settled within a task
   before anything is shuffled, then within the bucket: all but the first are removed whole.
2. What is left are first segments that share an anchor with a different one. Only their bytes
   are sent, bucket by bucket, and each block of buckets is sorted on its own: starts are
   ordered by anchor, offset, the first and the last V bytes, and long ties are resolved by
   ranks that were computed before for the positions of a difference cover modulo V: for any
   two starts there is a shift below V that takes both to ranked positions, so one comparison
   of ranks replaces that of the bytes between. Memory is bounded by the block.
   Buckets of more than HOT segments are dealt out start by start, by content.
3. The removed runs meet their documents; the shuffle of the texts is shared with step 2.

Cases: null text counts as empty; texts shorter than length lose nothing; rows of one doc_id
are documents one after another, in the order of their content's hash (equal rows: the later
loses what the earlier has); null doc_id comes after all others; empty table: empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, utf8

#: Bytes of a gram; bytes of text that are scanned, and of segments that are sorted, at a time.
GRAM, SCAN_BYTES, SORT_BYTES = 24, 4 << 20, 1 << 20
#: Segments of a bucket beyond which its starts are dealt out by content.
HOT = 2000
#: A perfect difference cover: each residue is a difference of two of its elements.
V, COVER = 13, (0, 1, 3, 9)
_PLACE = 20  # bits of a place for the run's starts and the anchor's offset


def _shifts() -> np.ndarray:
    """[r, s]: a shift d with r + d and s + d in the cover, modulo V."""
    out = np.full((V, V), -1)
    for r in range(V):
        for s in range(V):
            out[r, s] = next(d for d in range(V) if (r + d) % V in COVER and (s + d) % V in COVER)
    return out


SHIFT = _shifts()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _words(buf: bytes) -> np.ndarray:
    """The 8 bytes from each position of buf (which must have 7 more at its end)."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)).astype(np.uint64)


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor's offset from the first start, anchor, hash of the bytes) of each segment."""
    import xxhash

    window = length - GRAM + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = b"".join(texts) + b"\0" * (GRAM + window + 8)
    total = int(sizes.sum())
    base = np.cumsum(sizes) - sizes
    starts_of = np.maximum(0, sizes - length + 1)
    n = int(starts_of.sum())
    if not n:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    w = _words(buf)
    m = total + window
    gram = _mix(w[:m] * np.uint64(0xD6E8FEB86659FD93))
    for i in range(8, GRAM, 8):
        gram = _mix((gram ^ w[i : i + m]) * np.uint64(0xA0761D6478BD642F))
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(m, dtype=np.uint64)
    reach = 1
    while 2 * reach <= window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < window:
        least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
    of = np.repeat(np.arange(len(texts)), starts_of)
    p = np.arange(n) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of) + base[of]
    q = (least[p] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (of[1:] != of[:-1])]))
    count = np.diff(np.concatenate([first, [n]]))
    p0, anchor_at = p[first], q[first]
    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(view[a:b], o) for a, b, o in zip(p0.tolist(), (p0 + count - 1 + length).tolist(), (anchor_at - p0).tolist())), np.uint64, len(p0))
    return of[first], p0 - base[of[first]], count, anchor_at - p0, gram[anchor_at], hashes


def _pack(p0: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (p0 << _PLACE) | (count << 10) | offset


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> _PLACE, (place >> 10) & 1023, place & 1023


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    keys, texts, size = [], [], 0
    for b in batches:
        for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= SCAN_BYTES:
                yield np.array(keys, np.int64), texts
                keys, texts, size = [], [], 0
    if keys:
        yield np.array(keys, np.int64), texts


def _pieces(keys: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple]:
    """segments() of texts, with very long ones in overlapping pieces; starts count from the text's begin."""
    step = SCAN_BYTES
    if all(len(t) <= 2 * step for t in texts):
        of, p0, *rest = segments(texts, length)
        yield keys[of], p0, *rest
        return
    for key, text in zip(keys, texts):
        for at in range(0, max(1, len(text) - length + 1), step):
            of, p0, *rest = segments([text[at : at + step + length - 1]], length)
            yield np.full(len(of), key), p0 + at, *rest


def _scanner(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _blocks(batches):
            for key, p0, count, offset, anchor, digest in _pieces(keys, texts, length):
                order = np.lexsort((p0, key, digest, anchor))
                key, place, anchor, digest = key[order], _pack(p0, count, offset)[order], anchor[order].view(np.int64), digest[order].view(np.int64)
                again = np.zeros(len(key), bool)
                again[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
                # what this task has settled itself needs no bucket; it is dealt out by document
                anchor = np.where(again, key, anchor)
                for i in range(0, len(key), 50_000):
                    c = slice(i, i + 50_000)
                    yield pa.record_batch([pa.array(anchor[c]), pa.array(digest[c], mask=again[c]), pa.array(key[c]), pa.array(place[c])], ["anchor", "digest", "key", "place"])

    return run


def _found(docs: DataFrame, length: int) -> DataFrame:
    """(key, place, anchor, hot): segments to remove whole (anchor null), and first segments whose bucket holds others too."""
    rows = docs.mapInArrow(_scanner(length), "anchor long, digest long, key long, place long").repartition("anchor")
    bucket = Window.partitionBy("anchor")
    first = F.col("digest").isNotNull() & (F.row_number().over(Window.partitionBy("anchor", "digest").orderBy("key", "place")) == 1)
    rows = rows.withColumn("first", first).withColumn("n", F.sum(F.col("first").cast("int")).over(bucket))
    return rows.where("not first or n > 1").select("key", "place", F.when(F.col("first"), F.col("anchor")).alias("anchor"), (F.col("n") > HOT).alias("hot"))


def _bytes(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, text, wanted) to the bytes of wanted segments; hot buckets start by start."""
        import xxhash

        names = ["route", "key", "place", "bytes"]
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            seen: dict[bytes, int] = {}
            hot: list[tuple] = []
            for key, text, wanted in zip(*(b.column(c).to_pylist() for c in ("key", "text", "wanted"))):
                for w in wanted:
                    p0, n, offset = w["place"] >> _PLACE, (w["place"] >> 10) & 1023, w["place"] & 1023
                    if w["hot"]:
                        hot += ((key, p0 + i, offset - i, text[p0 + i : p0 + i + length]) for i in range(n))
                    else:
                        for column, value in zip(out, (w["anchor"], key, w["place"], text[p0 : p0 + n - 1 + length])):
                            column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
                    out = ([], [], [], [])
            for key, p, offset, s in sorted(hot, key=lambda x: x[:2]):
                again = s in seen
                seen[s] = 1
                # one that this task holds already is sent without bytes: it is removed
                for column, value in zip(out, (xxhash.xxh3_64_intdigest(s) - (1 << 63), key, (p << _PLACE) | (1 << 10) | offset, None if again else s)):
                    column.append(value)
            if out[0]:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)

    return run


def _rank(words: np.ndarray, at: np.ndarray, size: int, also: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Ranks of the strings of size bytes from positions at, after the keys in also; equal strings have equal ranks."""
    keys = [words[at + i] if i + 8 <= size else words[at + i] & np.uint64((1 << 8 * (size - i)) - 1) for i in range(0, size, 8)]
    keys += also
    order = np.lexsort(keys)
    new = np.zeros(len(at), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sort_block(route: np.ndarray, place: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start in it, if an equal string starts earlier) for all starts of a block of segments in the order of their documents."""
    _, count, offset = _unpack(place)
    sizes = np.array([len(x) for x in parts], np.int64)
    base = np.cumsum(sizes) - sizes
    words = _words(b"".join(parts) + b"\0" * (length + 8))
    of = np.repeat(np.arange(len(parts)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = base[of] + inside
    repeated = np.zeros(len(of), bool)
    # buckets, and in them the first and the last V bytes
    head = _rank(words, start, V, (offset[of] - inside, route[of]))
    head = _rank(words, start + length - V, V, (head,))
    rows = np.flatnonzero(np.bincount(head)[head] > 1)
    if not len(rows):
        return of, inside, repeated
    head, at = head[rows], start[rows]
    # cover sample: ranks of length - V bytes, at all positions that ties may ask for
    sample = np.unique(np.concatenate([at + d for d in range(V)]))
    sample = sample[np.isin(sample % V, COVER)]
    rank = np.zeros(int(sample[-1]) + 1, np.int64)
    rank[sample] = _rank(words, sample, length - V)
    wide = int(rank.max()) + 1
    residue = at % V
    earliest = rows.copy()  # rows are in the order of documents and starts
    for r in range(V):
        for s in range(r, V):
            pair = np.flatnonzero((residue == r) | (residue == s))
            if len(pair) < 2:
                continue
            key = head[pair] * wide + rank[at[pair] + SHIFT[r, s]]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.minimum.reduceat(earliest[pair[order]], new)
            earliest[pair[order]] = np.repeat(least, np.diff(np.concatenate([new, [len(key)]])))
    repeated[rows] = earliest < rows
    return of, inside, repeated


def _sorter(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            keys, places = np.array(key, np.int64), np.array(place, np.int64)
            order = np.lexsort((places, keys))
            of, inside, repeated = sort_block(np.array(route, np.int64)[order], places[order], [parts[i] for i in order], length)
            hit = np.flatnonzero(repeated)
            p = (places[order] >> _PLACE)[of[hit]] + inside[hit]
            k = keys[order][of[hit]]
            if len(hit):
                begin = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (k[1:] != k[:-1])])
                first = np.flatnonzero(begin)
                last = np.concatenate([first[1:], [len(p)]]) - 1
                yield pa.record_batch([pa.array(k[first]), pa.array(p[first]), pa.array(p[last] + length)], ["key", "start", "stop"])

        route, key, place, parts, size, whole = [], [], [], [], 0, []
        for b in batches:
            for r, k, at, x in zip(*(c.to_pylist() for c in b.columns)):
                if x is None:
                    whole.append((k, at >> _PLACE))
                    continue
                if size >= SORT_BYTES and r != route[-1]:
                    yield from flush()
                    route, key, place, parts, size = [], [], [], [], 0
                route.append(r)
                key.append(k)
                place.append(at)
                parts.append(x)
                size += len(x)
            if whole:
                yield pa.record_batch([pa.array([k for k, _ in whole], pa.int64()), pa.array([p for _, p in whole], pa.int64()), pa.array([p + length for _, p in whole], pa.int64())], ["key", "start", "stop"])
                whole = []
        if parts:
            yield from flush()

    return run


def keep_bytes(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(text without the runs, the maximal removed runs); runs in any order, overlapping or not."""
    spans: list[list[int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), [(a, b) for a, b in spans]


def _keeper(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, spans = [], []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
            k, s = keep_bytes(text, [(r["start"], r["stop"]) for r in runs or ()])
            kept.append(k)
            spans.append([{"start": x, "stop": y} for x, y in s])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.record_batch([b.column("doc_id"), pa.array([len(t) for t in b.column("text").to_pylist()], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): key is unique and in the order of documents; doc_id itself, where that is so."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    unique = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()
    if unique:
        return own.select(F.col("doc_id").alias("key"), "doc_id", "text")
    path = scratch(docs.sparkSession, "keyed")
    own.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, kept (binary) and spans (removed runs)."""
    if not GRAM + V < length < 512:
        raise ValueError(f"length must be over {GRAM + V} and under 512")
    keyed = _keyed(docs)
    found = cut(_found(keyed.select("key", "text"), length))
    texts = keyed.select("key", "doc_id", "text")
    wanted = found.where("anchor is not null").groupBy("key").agg(F.collect_list(F.struct("place", "anchor", "hot")).alias("wanted"))
    sent = texts.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_bytes(length), "route long, key long, place long, bytes binary")
    sorted_ = sent.repartition("route").sortWithinPartitions("route").mapInArrow(_sorter(length), "key long, start long, stop long")
    start = F.shiftright("place", _PLACE)
    whole = found.where("anchor is null").select("key", start.alias("start"), (start + F.shiftright("place", 10).bitwiseAND(1023) - 1 + length).alias("stop"))
    runs = whole.unionByName(sorted_).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return texts.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(_keeper, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what remove_repeats returned."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
