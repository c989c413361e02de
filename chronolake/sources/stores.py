"""Stores of packed and loose objects, and the files of a checkout.

Reads go through Spark's binaryFile source, so any store that Spark reaches will do; it lists on the
driver, though, and deals files out by fours of MB. Folders of very many small files that the sinks
wrote are listed and read by tasks instead. Sinks write through pyarrow's file systems from the
executors: each file gets its final name only when it is whole, so a task may run again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import codec
from ..functions import columns as C
from ..functions.udfs import inflate
from ..plans.shared import cut

#: Bytes of content after which a task begins its next pack or segment.
ROLL_BYTES = 64 << 20
#: Bytes of content that a task hands over at a time.
BATCH_BYTES = 8 << 20
#: Names of files that are not whole yet begin with it.
UNFINISHED = ".chronolake-"
OBJECTS = "sha string, type string, size long, content binary"
_OBJECTS = pa.schema([("sha", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def opened(uri: str):
    """(file system, path) of a location."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class Sink:
    """Writes files below a folder, each as a whole or not at all."""

    def __init__(self, folder: str, attempt: object) -> None:
        self.store, self.top = opened(folder.rstrip("/"))
        self.attempt, self.made = attempt, set()

    def put(self, name: str, *pieces: bytes) -> None:
        path = f"{self.top}/{name}"
        folder, _, last = path.rpartition("/")
        if folder not in self.made:
            self.store.create_dir(folder, recursive=True)
            self.made.add(folder)
        with self.store.open_output_stream(f"{folder}/{UNFINISHED}{self.attempt}-{last}", compression=None) as out:
            for x in pieces:
                out.write(x)
        self.store.move(f"{folder}/{UNFINISHED}{self.attempt}-{last}", path)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the whole files below folder, path from there on. Each folder is listed by a task, level by level: the driver sees no names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = opened(folder.rstrip("/"))
        for b in batches:
            for path in b.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{top}/{path}" if path else top, allow_not_found=True))
                found = [f for f in found if not f.base_name.startswith(UNFINISHED)]
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    names = [f"{path}/{f.base_name}" if path else f.base_name for f in part]
                    size = [f.size if f.type == fs.FileType.File else None for f in part]
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(size, pa.int64())], ["path", "length"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        met = cut(level.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, length long"))
        own = met.where("length is not null")
        files = own if files is None else files.unionByName(own)
        level = met.where("length is null").select("path")
        if level.isEmpty():
            return files


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the files below folder, which is in a store of pyarrow's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(names, pa.string()), pa.array(map(len, data), pa.int64()), pa.array(data, pa.binary())], ["path", "length", "content"])

        store, top = opened(folder.rstrip("/"))
        names, data, size = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_file(f"{top}/{path}") as f:
                    data.append(f.read())
                names.append(path)
                size += len(data[-1])
                if size >= BATCH_BYTES or len(data) >= 10_000:
                    yield out()
                    names, data, size = [], [], 0
        if data:
            yield out()

    # by number: by size, the few bytes of the names would be one task
    paths = listed(spark, folder).select("path").repartition(4 * spark.sparkContext.defaultParallelism)
    return paths.mapInArrow(run, "path string, length long, content binary")


# --- loose objects and chunks ----------------------------------------------------------------


def read_loose(spark: SparkSession, path: str, own: bool = False) -> DataFrame:
    """(sha, type, size, content) of the loose objects below path: .../objects/xx/yyy or .../loose/sha. What cannot be read has a null type. own: a folder of write_loose's."""
    files = read_files(spark, path) if own else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sha = F.concat(F.regexp_extract("path", "([0-9a-f]{2}|)/?([0-9a-f]{38}|[0-9a-f]{40})$", 1), F.regexp_extract("path", "([0-9a-f]{2}|)/?([0-9a-f]{38}|[0-9a-f]{40})$", 2))
    raw = files.select(sha.alias("sha"), inflate("content").alias("raw"))
    head = raw.withColumn("h", C.parse_header(F.col("raw")))
    return head.select("sha", "h.type", "h.size", "h.content")


def read_chunked(spark: SparkSession, path: str, locations: DataFrame) -> DataFrame:
    """(repo, sha, type, size, content) of objects inside chunk files; locations: repo, sha, chunk_key (path below path), offset, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").removeprefix("file:")
    files = files.select(F.regexp_replace("path", f"^.*{base}/", "").alias("chunk_key"), F.col("content").alias("chunk"))
    data = F.substring(F.col("chunk"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    met = locations.join(files, "chunk_key").select("repo", "sha", inflate(data).alias("raw")).withColumn("h", C.parse_header(F.col("raw")))
    return met.select("repo", "sha", "h.type", "h.size", "h.content")


def write_loose(objects: DataFrame, folder: str) -> DataFrame:
    """Writes objects (sha, type, content) as folder/loose/xx/yyy, xx being the first two digits of sha; (written) per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, n = Sink(f"{folder.rstrip('/')}/loose", TaskContext.get().taskAttemptId()), 0
        for b in batches:
            for sha, kind, body in zip(*(c.to_pylist() for c in b.columns)):
                sink.put(f"{sha[:2]}/{sha[2:]}", codec.loose_encode(kind, body))
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["written"])

    return objects.select("sha", "type", "content").mapInArrow(run, "written long")


def write_worktree(files: DataFrame, folder: str) -> DataFrame:
    """Writes blobs (path, type, content) as files below folder; others, and those without content, are passed over. (written) per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, n = Sink(folder, TaskContext.get().taskAttemptId()), 0
        for b in batches:
            for path, body in zip(*(c.to_pylist() for c in b.columns)):
                parts = [p for p in path.split("/") if p]
                if not parts or any(p in (".", "..", ".git") for p in parts):
                    raise ValueError(f"not a path for a checkout: {path}")
                sink.put("/".join(parts), body)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["written"])

    return files.where("type = 'blob' and content is not null").select("path", "content").mapInArrow(run, "written long")


# --- packs -----------------------------------------------------------------------------------


def _unpacked(packs: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for pack in packs:
        for sha, kind, body in codec.read_pack(pack):
            rows.append((sha, kind, len(body), body))
            size += len(body)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OBJECTS)], schema=_OBJECTS)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OBJECTS)], schema=_OBJECTS)


def unpack(packs: DataFrame, column: str = "content") -> DataFrame:
    """(sha, type, size, content) of all entries of packs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _unpacked(p.as_py() for b in batches for p in b.column(0))

    return packs.select(column).mapInArrow(run, OBJECTS)


def stage(packs: DataFrame, objects: DataFrame | None = None, column: str = "content") -> DataFrame:
    """The objects of packs, once each, that objects does not hold yet."""
    return staged(unpack(packs, column), objects)


def staged(found: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """What stage gives, of objects that are unpacked already."""
    new = found.dropDuplicates(["sha"])
    return new if objects is None else new.join(objects.select("sha"), "sha", "left_anti")


def _rolled(entries: Iterable[tuple[list[bytes], int]]) -> Iterator[tuple[list[bytes], int]]:
    """(pieces, entries) of about ROLL_BYTES; entries: (pieces, bytes of content)."""
    part, n, total = [], 0, 0
    for pieces, size in entries:
        part += pieces
        n += 1
        total += size
        if total >= ROLL_BYTES:
            yield part, n
            part, n, total = [], 0, 0
    if n:
        yield part, n


def segments(objects: DataFrame) -> DataFrame:
    """(segment, objects), one or more per task: pack entries of raw objects (with header)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n in _rolled(codec.segment_entries(x.as_py() for b in batches for x in b.column(0) if x.is_valid)):
            yield pa.record_batch([pa.array([b"".join(part)], pa.binary()), pa.array([n], pa.int64())], ["segment", "objects"])

    return objects.select("raw").mapInArrow(run, "segment binary, objects long")


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        store, path = opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        head = self.path[: len(self.path) - len(path)]
        return [_Part(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".pack")] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.path:
            store, path = opened(partition.path)
            with store.open_input_file(path) as f:
                yield from _unpacked([f.read()])


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        context, names = TaskContext.get(), []
        sink = Sink(self.path, context.taskAttemptId())
        for entries, n in _rolled((codec.pack_entry(r["type"], bytes(r["content"])), len(r["content"])) for r in iterator):
            names.append(f"part-{context.partitionId():06d}-{len(names):03d}.pack")
            sink.put(names[-1], *codec.pack_pieces(entries, n))
        return _Written(names)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for m in messages:
            for name in m.names if m else ():
                store, path = opened(f"{self.path}/{name}")
                store.delete_file(path)


class PackSource(DataSource):
    """spark.read.format("pack").load(folder), df.write.format("pack").save(folder): one task per pack, as deltas follow each other."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)


# --- hooks -----------------------------------------------------------------------------------


def read_hooks(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, commit_sha, payload) of hook records, one JSON object a line; broken lines leave nothing."""
    lines = spark.read.text(path).where(C.is_json(F.col("value")))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(get("repo_id").alias("repo_id"), get("commit_sha").alias("commit_sha"), F.col("value").alias("payload"))
