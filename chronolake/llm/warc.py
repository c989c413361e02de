"""WARC archives of pages, and a globally ordered index of their captures.

Writing: pages meet the smallest page_id of their payload digest (the minimum is combined
map-side; AQE may split a hot payload), then each task streams its rows into gzipped WARC
files in the shared folder. A file appears under its final name only when it is whole, and each
attempt of a task has names of its own: of a rerun or speculative task, only the files of the attempt
whose captures were committed are ever read, and no file is replaced. Each task hands on runs: RUN_ROWS
captures at a time, sorted by URL key, time and page.

Index merge: runs are dealt out by ranges of (URL key, time, page, archive, offset), so one URL
with very many captures spreads over ranges too, and there are as many ranges as hold RANGE_ROWS
captures each: a task's memory does not grow with the corpus. In each range the parts of the k runs
are merged by a loser tree. Ranges follow each other; their counts, a row per range, turn a capture's
place in its range into its position in the index as a whole.

Reading streams each archive member by member and recomputes the digests of payloads.

Cases: null html: an empty payload; null url: an empty URL key and no target header; null
page_id: never the response of a payload that a numbered page has, refers_to may be null
otherwise; repeated rows: a record each, as responses if they are the smallest; empty table:
no archive and an empty result; a page without a time is captured at EPOCH plus page_id
seconds; line breaks in a URL are percent-encoded in its header; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from hashlib import sha1
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, utf8

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: Compressed bytes after which a task opens its next file.
ROLL_BYTES = 256 << 20
#: Captures that a task sorts at a time; captures in a range of the index.
RUN_ROWS, RANGE_ROWS = 100_000, 500_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURE = pa.schema([("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.string())])
_CAPTURE_DDL = "url_key string, time string, page_id long, archive string, offset long, length long, run string"
_PLACED = pa.schema([*_CAPTURE, ("range", pa.int32()), ("place", pa.int64())])
_PLACED_DDL = _CAPTURE_DDL + ", range int, place long"
_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD_DDL = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(uri: str):
    """(file system, path) of a path in the shared folder, whatever store it is in."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: all captures of a host and path sort together."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower().split(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path.split("#", 1)[0]


def _time(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    digest = base64.b32encode(sha1(payload).digest()).decode()
    block = HTTP + (payload if response else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {_time(page_id):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if not response:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while block := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*block), schema)], schema=schema)


def _writer(folder: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = opened(folder)
        captures, files, out, at, sorted_ = [], 0, None, 0, 0
        name = ""

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal captures, sorted_
            run, captures = sorted(captures, key=_order), []
            yield from _batches((x + (f"{part:06d}-{sorted_:06d}",) for x in run), _CAPTURE)
            sorted_ += 1

        def close() -> None:
            out.close()
            store.move(f"{root}/.{attempt}-{name}", f"{root}/{name}")

        for b in batches:
            for page_id, url, payload, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id"))):
                response = first is None or first == page_id
                if out is None:
                    name, at = f"part-{part:06d}-{attempt}-{files:03d}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/.{attempt}-{name}", compression=None)
                    files += 1
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, response, first)) + packer.flush()
                out.write(member)
                captures.append((url_key(url), f"{_time(page_id):%Y%m%d%H%M%S}", page_id, f"{folder}/{name}", at, len(member)))
                at += len(member)
                if at >= ROLL_BYTES:
                    close()
                    out = None
                if len(captures) >= RUN_ROWS:
                    yield from hand_on()
        if out is not None:
            close()
        yield from hand_on()

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page below folder; returns the captures in sorted runs (url_key, time, page_id, archive, offset, length, run).

    Payloads under least_bytes are never revisits.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", utf8("html").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    alike = F.octet_length("payload") >= least_bytes
    # cut: the join's exchange is then one that AQE can split at a payload of very many pages
    first = cut(rows.where(alike).groupBy("digest").agg(F.min("page_id").alias("first_id")))
    marked = rows.join(first.hint("merge"), "digest", "left").select("page_id", "url", "payload", F.when(alike, F.col("first_id")).alias("first_id"))
    return cut(marked.mapInArrow(_writer(folder), _CAPTURE_DDL))


def _order(x: tuple) -> tuple:
    return x[0], x[1], x[2] is not None, x[2] or 0, x[3], x[4]


class LoserTree:
    """Merges k sorted iterators: an inner node keeps the loser of its match, so the next smallest costs one path."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list = [None] * self.k
        self.items: list = [None] * self.k
        for i in range(len(runs)):
            self._pull(i)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if len(runs) > 1 else 0

    def _pull(self, i: int) -> None:
        self.items[i] = next(self.runs[i], None)
        self.heads[i] = None if self.items[i] is None else (self.key(self.items[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return self.heads[a] <= self.heads[b]

    def _play(self, node: int) -> int:
        """The winner below node; leaves are k .. 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            yield self.items[self.winner]
            self._pull(self.winner)
            node = (self.winner + self.k) // 2
            while node:
                if self._beats(self.losers[node], self.winner):
                    self.winner, self.losers[node] = self.losers[node], self.winner
                node //= 2


def merge_runs(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of many runs, each run's in order, merged into one order. A run that comes in pieces is several runs."""
    runs: list[list] = []
    last: dict[str, list] = {}
    for row in rows:
        run = last.get(row[-1])
        if run is None or _order(row) < _order(run[-1]):
            run = last[row[-1]] = []
            runs.append(run)
        run.append(row)
    if runs:
        yield from LoserTree([iter(r) for r in runs], _order)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId()
    rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
    yield from _batches((row + (at, i) for i, row in enumerate(merge_runs(rows))), _PLACED)


def histories(captures: DataFrame) -> DataFrame:
    """All captures with their position (0 and up) in the order of (url_key, time, page_id, archive, offset)."""
    ranges = max(1, -(-captures.count() // RANGE_ROWS), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_range = captures.repartitionByRange(ranges, "url_key", "time", "page_id", "archive", "offset")
    placed = cut(by_range.mapInArrow(_merge, _PLACED_DDL))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    # a row per range: RANGE_ROWS times fewer than captures, and AQE checks its size before it is broadcast
    return placed.join(before, "range").withColumn("position", F.col("before") + F.col("place")).drop("range", "place", "before")


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked bytes) of each gzip member of a stream."""
    offset, start, rest = 0, 0, b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(size)
            if not rest:
                return
            out.append(unpack.decompress(rest))
            offset += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data
        yield start, b"".join(out)
        start = offset


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for archive in b.column(0).to_pylist():
            store, path = opened(archive)
            rows: list = []
            with store.open_input_stream(path, compression=None) as stream:
                for offset, raw in members(stream):
                    headers, payload = parse(raw)
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{archive} at {offset}: the payload does not have its digest")
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                    n = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    rows.append((archive, offset, page and int(page), n, digest, kind, refers and int(refers)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def read(captures: DataFrame) -> DataFrame:
    """The records of all archives that captures name."""
    archives = captures.select("archive").distinct()
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(tasks).mapInArrow(_read, _RECORD_DDL)  # few names stand for much data: not to be coalesced


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages, merges the index, and reads back the record of each indexed capture."""
    captures = write(pages, least_bytes=least_bytes)
    index = histories(captures).select("url_key", "time", "archive", "offset", "position")
    # both sides grow with the pages: never a broadcast
    met = index.hint("merge").join(read(captures), ["archive", "offset"], "left")
    missed = F.raise_error(F.concat(F.lit("no record at "), "archive", F.lit(" "), F.col("offset").cast("string"))).cast("string")
    digest = F.coalesce("payload_digest", missed).alias("payload_digest")
    return met.select("page_id", "payload_bytes", digest, "record_type", "refers_to", "url_key", "time", "position")
