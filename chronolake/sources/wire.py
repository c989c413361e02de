"""Captured messages of the transfer protocol as rows: framed lines, ref advertisements, channels, push reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import codec


def _exploded(captures: DataFrame, key: str, column: str, rows: Callable, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    kind = captures.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *r) for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(data or b"")]
            columns = list(zip(*out)) if out else [()] * (len(fields) + 1)
            yield pa.record_batch([pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, t) for c, (_, _, t) in zip(columns[1:], fields))], [key, *(n for n, _, _ in fields)])

    return captures.select(key, column).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` {d}" for n, d, _ in fields)]))


def lines(captures: DataFrame, key: str, column: str) -> DataFrame:
    """(key, section, ord, line) of framed lines; ends at the first malformed one."""
    rows = lambda x: ((i, j, line) for i, s in enumerate(codec.pkt_sections(x)) for j, line in enumerate(s))
    return _exploded(captures, key, column, rows, [("section", "long", pa.int64()), ("ord", "long", pa.int64()), ("line", "binary", pa.binary())])


def refs(captures: DataFrame, key: str, column: str, version: int = 1) -> DataFrame:
    """(key, name, sha) of a version 1 advertisement or a version 2 answer to ls-refs."""
    parse = codec.parse_refs_v1 if version == 1 else codec.parse_ls_refs
    return _exploded(captures, key, column, lambda x: parse(x).refs.items(), [("name", "string", pa.string()), ("sha", "string", pa.string())])


def fetched(captures: DataFrame, key: str, column: str, version: int = 1, sideband: bool = True) -> DataFrame:
    """(key, pack, progress, errors) of fetch responses."""

    def rows(x: bytes) -> Iterator[tuple]:
        f = codec.demux(x, version, sideband)
        yield f.pack, f.progress, f.errors

    return _exploded(captures, key, column, rows, [("pack", "binary", pa.binary()), ("progress", "string", pa.string()), ("errors", "string", pa.string())])


def push_reports(captures: DataFrame, key: str, column: str) -> DataFrame:
    """(key, unpacked, ref, ok, error) of push responses."""

    def rows(x: bytes) -> Iterator[tuple]:
        unpacked, _, found = codec.parse_push(x)
        return ((unpacked, *r) for r in found)

    return _exploded(captures, key, column, rows, [("unpacked", "boolean", pa.bool_()), ("ref", "string", pa.string()), ("ok", "boolean", pa.bool_()), ("error", "string", pa.string())])
