"""Repositories, commits, trees and provenance as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .shared import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, sha, content): a blob per document."""
    small_batches(spark)
    d = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select("doc_id", path.alias("path"), C.object_id("blob", content).alias("sha"), content.alias("content"))


def blob_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, status, old_content, new_content): document d against d + 1; the last has no successor."""
    small_batches(spark)
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    new = b.select((F.col("doc_id") - 1).alias("doc_id"), F.col("content").alias("new_content"))
    met = b.withColumnRenamed("content", "old_content").join(new, "doc_id", "left")
    status = F.when(F.col("new_content").isNull(), "deleted").otherwise("modified")
    return met.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), status.alias("status"), "old_content", "new_content")


def turn_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, turn, sha, parent, author, message, summary): a linear history per conversation."""
    c = table(spark, sf_dir, "conversations")
    sha = lambda t: F.sha1(F.concat_ws("/", "conv_id", t))
    return c.select(F.col("conv_id").alias("repo"), "turn", sha("turn").alias("sha"), F.when(F.col("turn") > 0, sha(F.col("turn") - 1)).alias("parent"), F.col("role").alias("author"), F.col("text").alias("message"), F.substring_index("text", "\n", 1).alias("summary"))


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, turn, depth, content): one file per conversation, at each turn the texts of the last three turns."""
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    content = F.array_join(F.collect_list("text").over(order.rowsBetween(-2, 0)), "\n")
    head = F.max("turn").over(Window.partitionBy("conv_id"))
    return c.select(F.col("conv_id").alias("key"), "turn", (head - F.col("turn")).alias("depth"), content.alias("content"))


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commits, parents): a graph with merges per customer. Commits: repo, n, sha, author_ts, message; parents: repo, sha, ord, parent."""
    o = table(spark, sf_dir, "orders")
    n = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long")
    commits = o.select(F.col("o_custkey").cast("string").alias("repo"), n.alias("n"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"), F.col("o_totalprice").alias("price"))
    commits = commits.select("repo", "n", F.col("n").cast("string").alias("sha"), F.floor(F.col("us") / 1000000).cast("long").alias("author_ts"), "message", "price")
    k = F.col("n")
    up = F.when(k == 0, F.array(F.lit(None).cast("long"))).when(k == 1, F.array(F.lit(0).cast("long"))).when(k % 5 == 0, F.array(k - 2, k - 1)).otherwise(F.array(k - 2))
    parents = commits.select("repo", "sha", F.posexplode(up).alias("ord", "p")).select("repo", "sha", "ord", F.col("p").cast("string").alias("parent"))
    return commits, parents


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, mode, sha, kept): region/nation/customer as files of one repository; kept marks the second snapshot."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    met = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows by the schema's definition
    path = F.concat_ws("/", "r_name", F.regexp_replace("n_name", "/", "-"), "c_name")
    return met.select(F.lit("customers").alias("repo"), path.alias("path"), F.lit("100644").alias("mode"), C.object_id("blob", F.col("c_name").cast("binary")).alias("sha"), (F.col("c_acctbal") >= 0).alias("kept"), "c_custkey")


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_sha, mode, name, sha) of customer_files, with ids that stand for trees; the root is "root"."""
    f = customer_files(spark, sf_dir)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    region, nation = F.concat(F.lit("r:"), part(1)), F.concat(F.lit("n:"), part(1), F.lit("/"), part(2))
    leaf = f.select(nation.alias("tree_sha"), "mode", part(3).alias("name"), "sha")
    middle = f.select(region.alias("tree_sha"), F.lit("40000").alias("mode"), part(2).alias("name"), nation.alias("sha")).distinct()
    top = f.select(F.lit("root").alias("tree_sha"), F.lit("40000").alias("mode"), part(1).alias("name"), region.alias("sha")).distinct()
    return leaf.unionByName(middle).unionByName(top)


def provenance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, turn, agent, session_id, k, ts, event_id, ms): writes of provenance, in the order of (ts, event_id)."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") % 16).alias("turn"), F.col("event_type").alias("agent"), F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").cast("int").alias("k"), "ts", "event_id", ms.alias("ms"))


def prompt_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, text, conv_id, turn): user turns as prompts; some ids are shared on purpose."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    own = F.substring(F.sha2("text", 256), 1, 16)
    shared = F.concat(F.lit("shared-"), (F.col("conv_id") % 10).cast("string"))
    return c.select(F.when(F.col("turn") == 0, shared).otherwise(own).alias("prompt_id"), "text", "conv_id", "turn")
