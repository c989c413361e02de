"""Reading objects in batches: contents, commits, locations, dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

DEFAULT_BYTES, MOST_BYTES = 1 << 20, 8 << 20


def read_blobs(wanted: DataFrame, objects: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(repo, sha, size, content_base64, error) of wanted (repo, sha); objects: repo, sha, type, content, with null type for a malformed header."""
    cap = min(max_bytes if max_bytes is not None else DEFAULT_BYTES, MOST_BYTES)
    held = objects.select("repo", "sha", "type", "content", F.lit(True).alias("there"))
    met = wanted.select("repo", "sha").join(held, ["repo", "sha"], "left")
    size = F.octet_length("content").cast("long")
    error = F.when(F.col("there").isNull(), "object not found").when(F.col("type").isNull(), "malformed git object header").when(F.col("type") != "blob", F.concat(F.lit("not a blob (got "), "type", F.lit(")")))
    error = error.when(size > cap, F.concat(F.lit("blob exceeds maxBlobBytes ("), size.cast("string"), F.lit(f" > {cap})")))
    met = met.withColumn("error", error).withColumn("size", size)
    ok = F.col("error").isNull()
    return met.select("repo", "sha", F.when(ok, F.col("size")).alias("size"), F.when(ok, F.regexp_replace(F.base64("content"), "[\r\n]", "")).alias("content_base64"), "error")


def parse_commits(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """The fields of each wanted commit (repo, sha), or an error beside nulls."""
    held = objects.select("repo", "sha", "type", "content", F.lit(True).alias("there"))
    met = wanted.select("repo", "sha").join(held, ["repo", "sha"], "left")
    error = F.when(F.col("there").isNull(), "object not found").when(~F.col("type").eqNullSafe(F.lit("commit")), "not a commit object")
    parsed = F.when(error.isNull(), C.parse_commit(C.text_of(F.col("content"))))
    return met.select("repo", "sha", parsed.alias("c"), error.alias("error")).select("repo", "sha", "c.*", "error")


def locate(wanted: DataFrame, locations: DataFrame) -> DataFrame:
    """wanted (repo, sha) with where each object lies; those without a place are dropped."""
    return wanted.join(locations, ["repo", "sha"])


def check_scope(keys: DataFrame, key: str, repo: str) -> DataFrame:
    """keys, unless one of them leaves its repository's prefix: then the whole batch is an error."""
    bad = ~C.in_scope(F.col(key), F.col(repo))
    return keys.where(F.when(bad, F.raise_error(F.concat(F.lit("Invalid key scope: "), F.col(key))).cast("boolean")).otherwise(F.lit(True)))


def batches(rows: DataFrame, index: str, size: int, slots: int) -> DataFrame:
    """Adds batch and slot to rows by their index from 0: round robin over slots."""
    batch = F.floor(F.col(index) / size).cast("long")
    return rows.withColumn("batch", batch).withColumn("slot", F.pmod(F.col("batch"), F.lit(slots)))


def chunk_slices(locations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo, sha, data): bytes of objects inside chunks (repo, chunk_key, content); locations: repo, sha, chunk_key, offset, length."""
    cut_ = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return locations.join(chunks, ["repo", "chunk_key"]).select("repo", "sha", cut_.alias("data"))
