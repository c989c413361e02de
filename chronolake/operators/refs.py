"""Branches and tags: listing, and updates that check what a ref was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import NULL_SHA
from ..functions.columns import SHA1


def under(refs: DataFrame, prefix: str) -> DataFrame:
    """refs (repo, name, sha) below a prefix, as short (the name without it)."""
    return refs.where(F.col("name").startswith(prefix)).withColumn("short", F.substr("name", F.lit(len(prefix) + 1)))


def update(refs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs after it, outcome of each update: repo, name, ok, error).

    updates: repo, name, old_sha, new_sha, one per ref; NULL_SHA as old one creates, as new one
    deletes. An update whose old_sha is not what the ref is changes nothing.
    """
    held = refs.select("repo", "name", "sha")
    met = updates.join(held, ["repo", "name"], "left").withColumn("now", F.coalesce("sha", F.lit(NULL_SHA)))
    error = F.when(~F.col("name").startswith("refs/"), "not a ref name").when(~F.col("old_sha").rlike(SHA1) | ~F.col("new_sha").rlike(SHA1), "not a sha").when(F.col("now") != F.col("old_sha"), "stale info")
    done = met.withColumn("error", error)
    new = done.where("error is null").select("repo", "name", F.col("new_sha").alias("sha"))
    after = held.join(new.select("repo", "name"), ["repo", "name"], "left_anti").unionByName(new.where(F.col("sha") != NULL_SHA))
    return after, done.select("repo", "name", F.col("error").isNull().alias("ok"), "error")
