"""Exact deduplication through a cuckoo-filter index.

The index keeps 16-bit fingerprints in buckets of four slots. Every slot also names a
stored entry (the full 256-bit content digest with its payload), so that

* a fingerprint hit is verified against the content stored for that bucket,
* a digest can be deleted again without hurting others that share its fingerprint,
* an insertion that finds no free slot doubles the table from the stored keys.

Plan: one pass over the texts makes digests (no text is shuffled). Each map task folds its
digests through an index of its own, so a group of copies leaves a task as one row however
large it is; the rows meet by digest, sorted, where the same index merges them a stretch of digests
at a time. The result is joined
back to the digests, which AQE may split where one digest is hot.

Cases: null text counts as empty (all such rows are copies of each other); a null doc_id is
lower than any other; of repeated rows (same doc_id and text) exactly one stays; an empty
table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, utf8

SLOTS = 4
MAX_KICKS = 200
#: A task hands on what its index holds after so many live digests.
COMBINE_KEYS = 200_000

_GROUP = "digest binary, keep_id long, keep_row long, group_size long"
_GROUP_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


class CuckooIndex:
    """Live digests (bytes of at least 8) with a payload each."""

    def __init__(self, buckets: int = 1024) -> None:
        self.buckets = 1 << max(1, buckets - 1).bit_length()
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        n = self.buckets * SLOTS
        self.prints, self.entry = [0] * n, [-1] * n

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[:2], "big") or 1
        one = int.from_bytes(key[2:8], "big") & (self.buckets - 1)
        return fp, one, self._other(one, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ (((fp * 0x5BD1E995) >> 4) & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        """The slot that holds key, or -1. Fingerprint hits count only if the stored key is the same."""
        fp, one, two = self._places(key)
        for bucket in (one, two):
            base = bucket * SLOTS
            for slot in range(base, base + SLOTS):
                if self.prints[slot] == fp and self.keys[self.entry[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """The entry of key, or -1."""
        slot = self._slot(key)
        return -1 if slot < 0 else self.entry[slot]

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) >= 0

    def insert(self, key: bytes, value) -> int:
        """Adds a digest that is not live yet (else an error: copies would fill both buckets); returns its entry."""
        if key in self:
            raise ValueError("the digest is live already")
        if self.free:
            at = self.free.pop()
            self.keys[at], self.values[at] = key, value
        else:
            at = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        if not self._place(key, at):
            self._grow()
        return at

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        at = self.entry[slot]
        self.prints[slot], self.entry[slot] = 0, -1
        self.keys[at], self.values[at] = None, None
        self.free.append(at)
        return True

    def _place(self, key: bytes, at: int) -> bool:
        fp, one, two = self._places(key)
        bucket = one
        for kick in range(MAX_KICKS):
            for b in (one, two) if kick == 0 else (bucket,):
                base = b * SLOTS
                for slot in range(base, base + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.entry[slot] = fp, at
                        return True
            slot = bucket * SLOTS + (kick + fp) % SLOTS
            fp, self.prints[slot] = self.prints[slot], fp
            at, self.entry[slot] = self.entry[slot], at
            bucket = self._other(bucket, fp)
        return False

    def _grow(self) -> None:
        """Overflow: a table of twice the buckets, refilled from the stored keys."""
        while True:
            self.buckets *= 2
            self.resizes += 1
            self._clear()
            if all(self._place(k, at) for at, k in enumerate(self.keys) if k is not None):
                return

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [sha256(t.lower()).digest() for t in b.column("text").to_pylist()]  # bytes.lower() changes A-Z alone
        yield pa.record_batch([b.column("doc_id"), b.column("row"), pa.array(digests, pa.binary())], ["doc_id", "row", "digest"])


def _best(a: tuple, b: tuple) -> tuple:
    """The row that stays: largest doc_id, a null below all; then the earliest row."""
    rank = lambda x: (x[0] is not None, x[0] or 0, -x[1])
    return a if rank(a) >= rank(b) else b


def _fold(rows: Iterable[tuple], limit: int) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id, row, count) folded through an index; handed on at limit live digests."""
    index = CuckooIndex()

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(k, *v) for k, v in index.items()]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + 20_000]), _GROUP_ARROW)], schema=_GROUP_ARROW)

    for digest, doc_id, row, n in rows:
        at = index.find(digest)
        if at < 0:
            if len(index) >= limit:
                yield from out()
                index = CuckooIndex()
            index.insert(digest, (doc_id, row, n))
        else:
            old = index.values[at]
            index.values[at] = (*_best(old[:2], (doc_id, row)), old[2] + n)
    yield from out()


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold(((d, i, r, 1) for b in batches for d, i, r in zip(*(b.column(c).to_pylist() for c in ("digest", "doc_id", "row")))), COMBINE_KEYS)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: what an index holds is whole when a new digest finds it full."""
    return _fold((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))), COMBINE_KEYS)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of each row; row tells rows apart. Written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), utf8().alias("text"))
    return cut(rows.mapInArrow(_digest_batches, "doc_id long, row long, digest binary"))


def groups(digested: DataFrame) -> DataFrame:
    """One row per distinct digest: (digest, keep_id, keep_row, group_size)."""
    parts = digested.mapInArrow(_combine, _GROUP)
    return parts.repartition("digest").sortWithinPartitions("digest").mapInArrow(_merge, _GROUP)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    d = digests(docs)
    return d.join(groups(d), "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. docs is read twice, and shuffled once by (doc_id, digest)."""
    key = lambda digest: F.concat_ws("|", F.coalesce(F.col("__id").cast("string"), F.lit("null")), digest)
    kept = groups(digests(docs)).select(F.col("keep_id").alias("__id"), F.lower(F.hex("digest")).alias("__digest")).select(key(F.col("__digest")).alias("__key"))
    # A-Z alone are lowered, as in the digests
    own = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    # rows are numbered as in digests, so that of equal ones the same stays
    hit = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", key(own)).join(kept, "__key")
    first = F.row_number().over(Window.partitionBy("__key").orderBy("__row"))
    return hit.withColumn("__n", first).where("__n = 1").select(*[docs[c] for c in docs.columns])


def _state_change(key, index_rows, changes):
    """Applies deletions, then insertions, to the live digests of one bucket."""
    import pandas as pd

    index = CuckooIndex()
    for k, n in zip(index_rows["digest"], index_rows["copies"]):
        at = index.find(bytes(k))
        if at < 0:
            index.insert(bytes(k), int(n))
        else:
            index.values[at] += int(n)
    for k, sign in sorted(((bytes(k), int(s)) for k, s in zip(changes["digest"], changes["change"])), key=lambda x: x[1]):
        at = index.find(k)
        if sign < 0 and at >= 0:
            if index.values[at] + sign <= 0:
                index.delete(k)
            else:
                index.values[at] += sign
        elif sign > 0 and at >= 0:
            index.values[at] += sign
        elif sign > 0:
            index.insert(k, sign)
    rows = list(index.items())
    return pd.DataFrame({"bucket": [int(key[0])] * len(rows), "digest": [k for k, _ in rows], "copies": [v for _, v in rows]})


def update_index(index: DataFrame | None, inserted: DataFrame, deleted: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """Live digests (bucket, digest, copies) after documents come and go.

    inserted, deleted: columns digest. Changes are summed per digest before they are shuffled;
    buckets must grow with the number of live digests, as a bucket is handled by one task. A digest
    that index holds several times counts as one, with the sum of its copies.
    """
    changes = inserted.select("digest", F.lit(1).alias("change"))
    if deleted is not None:
        changes = changes.unionByName(deleted.select("digest", F.lit(-1).alias("change")))
    changes = changes.groupBy("digest", F.signum("change").alias("s")).agg(F.sum("change").alias("change")).drop("s")
    changes = changes.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    if index is None:
        index = changes.sparkSession.createDataFrame([], "bucket long, digest binary, copies long")
    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(_state_change, "bucket long, digest binary, copies long")
