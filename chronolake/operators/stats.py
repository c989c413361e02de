"""Counts over repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contributors(commits: DataFrame) -> DataFrame:
    """(repo, contributor, commits, last_ts): contributor is "name <e-mail>"."""
    who = F.concat("author", F.lit(" <"), "author_email", F.lit(">"))
    return commits.groupBy("repo", who.alias("contributor")).agg(F.count(F.lit(1)).alias("commits"), F.max("author_ts").alias("last_ts"))


def repo_stats(commits: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, commits, branches, tags, files, bytes); refs: repo, name; files: repo, size."""
    c = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))
    kind = lambda p: F.count(F.when(F.col("name").startswith(p), 1))
    r = refs.groupBy("repo").agg(kind("refs/heads/").alias("branches"), kind("refs/tags/").alias("tags"))
    f = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return c.join(r, "repo", "left").join(f, "repo", "left").select("repo", "commits", *map(zero, ("branches", "tags", "files", "bytes")))


def repos(commits: DataFrame, owner: str | None = None) -> DataFrame:
    """Repositories that have a commit; owner: only those below owner/."""
    out = commits.select("repo").distinct()
    return out if owner is None else out.where(F.col("repo").startswith(f"{owner}/"))


def share_by(blamed: DataFrame, key: str) -> DataFrame:
    """(key, lines, share) of blamed lines; lines without provenance have a null key."""
    from pyspark.sql import Window

    counts = blamed.groupBy(key).agg(F.count(F.lit(1)).alias("lines"))
    return counts.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy()))  # over one row per key
