"""Arrow-batched functions for what has no built-in: compression, deltas, tree bytes, line diffs."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import codec, diff

ENTRIES = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("name", T.StringType()), T.StructField("sha", T.StringType())]))
_ENTRIES = pa.list_(pa.struct([("ord", pa.int32()), ("mode", pa.string()), ("name", pa.string()), ("sha", pa.string())]))


def _each(values: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """f of each value; null for null and for what breaks its format."""
    out = []
    for x in values.to_pylist():
        try:
            out.append(None if x is None else f(x))
        except codec.FormatError:
            out.append(None)
    return pa.array(out, kind)


@arrow_udf(T.BinaryType())
def inflate(data: pa.Array) -> pa.Array:
    return _each(data, lambda x: codec.inflate(x)[0], pa.binary())


@arrow_udf(T.LongType())
def inflate_used(data: pa.Array) -> pa.Array:
    """How many compressed bytes the first stream takes."""
    return _each(data, lambda x: codec.inflate(x)[1], pa.int64())


@arrow_udf(T.BinaryType())
def deflate(data: pa.Array) -> pa.Array:
    return _each(data, lambda x: zlib.compress(x, 6), pa.binary())


@arrow_udf(T.BinaryType())
def deflate_stored(data: pa.Array) -> pa.Array:
    return _each(data, lambda x: zlib.compress(x, 0), pa.binary())


@arrow_udf(T.StructType([T.StructField("sha", T.StringType()), T.StructField("data", T.BinaryType())]))
def loose_object(kind: pa.Array, body: pa.Array) -> pa.Array:
    """Id and compressed bytes of objects in one pass."""
    made = [None if k is None or b is None else {"sha": codec.object_id(k, b), "data": codec.loose_encode(k, b)} for k, b in zip(kind.to_pylist(), body.to_pylist())]
    return pa.array(made, pa.struct([("sha", pa.string()), ("data", pa.binary())]))


def _pairs(a: pa.Array, b: pa.Array, f) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        try:
            out.append(None if x is None or y is None else f(x, y))
        except codec.FormatError:
            out.append(None)
    return pa.array(out, pa.binary())


@arrow_udf(T.BinaryType())
def delta_apply(base: pa.Array, delta: pa.Array) -> pa.Array:
    return _pairs(base, delta, codec.delta_apply)


@arrow_udf(T.BinaryType())
def delta_create(base: pa.Array, target: pa.Array) -> pa.Array:
    return _pairs(base, target, codec.delta_create)


@arrow_udf(ENTRIES)
def parse_tree(body: pa.Array) -> pa.Array:
    return _each(body, lambda x: [{"ord": i, "mode": m, "name": n, "sha": s} for i, (m, n, s) in enumerate(codec.parse_tree(x))], _ENTRIES)


@arrow_udf(T.StringType())
def unified_diff(old: pa.Array, new: pa.Array, path: pa.Array, context: pa.Array) -> pa.Array:
    """The patch of each pair; a missing side counts as empty."""
    rows = zip(old.to_pylist(), new.to_pylist(), path.to_pylist(), context.to_pylist())
    return pa.array([diff.unified(a or "", b or "", p, p, c) for a, b, p, c in rows], pa.string())


def patch(old, new, path, context: int = 3):
    return unified_diff(old, new, path, F.lit(context))
