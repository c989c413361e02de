"""Searching and comparing file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.udfs import patch



def grep(blobs: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """Matching lines of text blobs with the lines around them: path, sha, line_number, line, is_match.

    blobs: path, sha, content (binary). Binary blobs are passed over. Contexts that overlap are
    united. The work is done on each blob's array of lines, so nothing is shuffled; blobs without
    a match leave before any line is exploded. A line is matched by itself, so the multi-line
    flag is not needed (with it, ^ would not match an empty line in this regex dialect).
    """
    c = max(0, context)
    lined = blobs.where(~C.is_binary(F.col("content"))).select("path", "sha", C.split_lines(C.text_of(F.col("content")), "grep").alias("lines"))
    hits = F.transform("lines", lambda x: x.rlike(pattern))
    found = lined.withColumn("hits", hits).where(F.exists("hits", lambda h: h))
    near = lambda i: F.exists(F.slice("hits", F.greatest(i - c, F.lit(0)) + 1, F.least(i, F.lit(c)) + c + 1), lambda h: h)
    rows = F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("line"), F.get("hits", i).alias("is_match"), near(i).alias("near")))
    return found.select("path", "sha", F.inline(F.filter(rows, lambda r: r["near"]))).drop("near")


def grep_files(blobs: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """One row per matching blob: path, sha, lines (in order)."""
    found = grep(blobs, pattern, context)
    return found.groupBy("path", "sha").agg(F.array_sort(F.collect_list(F.struct("line_number", "line", "is_match"))).alias("lines"))


def diff_meta(pairs: DataFrame) -> DataFrame:
    """path, status, is_binary, old_size, new_size of pairs (path, status, old_content, new_content: binary or null)."""
    empty = F.unhex(F.lit(""))
    side = lambda c: F.coalesce(F.col(c), empty)
    binary = C.is_binary(side("old_content")) | C.is_binary(side("new_content"))
    size = lambda c: F.octet_length(c).cast("long")
    return pairs.select("path", "status", binary.alias("is_binary"), size("old_content").alias("old_size"), size("new_content").alias("new_size"), "old_content", "new_content")


def diff_blobs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """diff_meta with the patch of text pairs; binary ones have none."""
    text = lambda c: C.text_of(F.when(~F.col("is_binary"), F.col(c)))
    made = patch(text("old_content"), text("new_content"), F.col("path"), context)
    meta = diff_meta(pairs).withColumn("made", made)
    return meta.select("path", "status", "is_binary", "old_size", "new_size", F.when(~F.col("is_binary"), F.col("made")).alias("patch"))


def pair_by_sha(changes: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds old_content and new_content to changes (path, status, old_sha, new_sha); what is missing stays null."""
    side = lambda n: objects.select(F.col("sha").alias(f"{n}_sha"), F.col("content").alias(f"{n}_content"))
    return changes.join(side("old"), "old_sha", "left").join(side("new"), "new_sha", "left")


def line_count(text: Column) -> Column:
    return F.size(C.split_lines(text, "diff")).cast("long")
