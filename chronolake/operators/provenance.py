"""Which prompt, session and agent made a commit: validated writes, lookups and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

STRINGS = ("prompt_id", "model", "agent", "session_id", "parent_session_id", "human_author_email")
PAYLOAD = ("prompt_id", "model", "agent", "session_id", "parent_session_id", "human_edited", "human_author_email", "metadata_json")


def validate(rows: DataFrame) -> DataFrame:
    """rows with repo_id in lower case and error: the message of the first rule that is broken, or null."""
    present = {n: F.col(n) for n in STRINGS if n in rows.columns}
    json = F.col("metadata_json") if "metadata_json" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("error", C.metadata_error(F.col("repo_id"), F.col("commit_sha"), present, json)).withColumn("repo_id", F.lower("repo_id"))


def upsert(rows: DataFrame, keys: list[str], payload: list[str], order: list[str], created: str) -> DataFrame:
    """One row per key: the payload of the last write, nulls included, and created of the first.

    Both combine map-side, so a key that is written very often is no burden.
    """
    at = F.struct(*order)
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), at).alias("p"), F.min_by(created, at).alias(created))
    return agg.select(*keys, *(F.col(f"p.{n}").alias(n) for n in payload), created)


def insert_prompts(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored prompts, outcome of each write) of rows (prompt_id, text, order...).

    The first valid text of an id stays; the same text again is accepted (200, dedup), another
    one is a conflict (409), an invalid one is rejected (400).
    """
    checked = rows.withColumn("error", C.prompt_error(F.col("prompt_id"), F.col("text"))).withColumn("text_hash", F.sha2(F.col("text"), 256)).withColumn("size_bytes", F.octet_length("text").cast("long"))
    good = checked.where("error is null")
    at = F.struct(*order)
    first = good.groupBy("prompt_id").agg(F.min_by(F.struct("text", "text_hash", "size_bytes", *order), at).alias("f")).select("prompt_id", "f.*")
    stored = first.select("prompt_id", "text", "text_hash", "size_bytes", *order)
    head = first.select(F.col("prompt_id").alias("id"), F.col("text_hash").alias("first_hash"), F.struct(*order).alias("first_at"))
    met = good.join(head, F.col("prompt_id") == F.col("id"))
    status = F.when(F.struct(*order) == F.col("first_at"), 201).when(F.col("text_hash") == F.col("first_hash"), 200).otherwise(409)
    ok = met.select("prompt_id", *order, "text_hash", "size_bytes", status.cast("long").alias("status"), (status == 200).alias("dedup"), F.lit(None).cast("string").alias("error"))
    bad = checked.where("error is not null").select("prompt_id", *order, "text_hash", "size_bytes", F.lit(400).cast("long").alias("status"), F.lit(False).alias("dedup"), "error")
    return stored, ok.unionByName(bad)


def lookup(metadata: DataFrame, repo_id: str, commit_sha: str) -> DataFrame:
    return metadata.where((F.col("repo_id") == repo_id.lower()) & (F.col("commit_sha") == commit_sha))


def prompt(prompts: DataFrame, prompt_id: str) -> DataFrame:
    return prompts.where(F.col("prompt_id") == prompt_id)


def by_key(metadata: DataFrame, **wanted: str) -> DataFrame:
    """Rows of a session, prompt, agent and so on; null never matches."""
    for name, value in wanted.items():
        metadata = metadata.where(F.col(name) == value)
    return metadata


def recent(metadata: DataFrame, keys: list[str], created: str, n: int) -> DataFrame:
    """The n newest rows per key, with rank from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(created), *[c for c in metadata.columns if c not in keys and c != created])
    return metadata.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def api_shape(metadata: DataFrame) -> DataFrame:
    """As the service answers: human_edited as a boolean, metadata_json as a variant (null if it is no JSON)."""
    return metadata.withColumn("human_edited", F.col("human_edited").cast("boolean")).withColumn("metadata_json", F.when(C.is_json(F.col("metadata_json")), F.try_parse_json("metadata_json")))


def with_provenance(blamed: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Blamed lines with the provenance of their commits; nulls where there is none."""
    return blamed.join(metadata, keys, "left")


def lines_in_ranges(lines: DataFrame, ranges: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Lines (keys, line_number) inside inclusive ranges (keys, line_start, line_end).

    Ranges and lines meet in blocks of width lines, so this is an equi-join that spreads over
    tasks, not a nested loop.
    """
    block = F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width)))
    r = ranges.where(F.col("line_start") <= F.col("line_end")).withColumn("block", block)
    met = lines.withColumn("block", F.floor(F.col("line_number") / width)).join(r, [*keys, "block"])
    return met.where(F.col("line_number").between(F.col("line_start"), F.col("line_end"))).drop("block")


def notes_to_metadata(notes: DataFrame, repo_id: Column, agent: str, since: Column | None = None) -> DataFrame:
    """Metadata rows of snapshot notes (commit_sha, commit_ts, note: JSON text); since: only commits that are newer."""
    get = lambda k: F.get_json_object("note", f"$.{k}")
    rows = notes if since is None else notes.where(F.col("commit_ts") > since)
    any_ = get("tool").isNotNull() | get("files").isNotNull()
    made = F.to_json(F.struct(get("tool").alias("tool"), F.from_json(get("files"), "array<string>").alias("files"), get("timestamp").alias("snapshot_at"), get("branch").alias("branch")))
    return rows.select(repo_id.alias("repo_id"), "commit_sha", F.lit(agent).alias("agent"), get("sessionId").alias("session_id"), F.when(any_, made).alias("metadata_json"))


def hook_to_metadata(hooks: DataFrame, agent: str) -> DataFrame:
    """Metadata rows of tool hooks (repo_id, commit_sha, payload: JSON text); hooks without repository or commit leave nothing."""
    tool = F.get_json_object("payload", "$.tool_name")
    rows = hooks.where("repo_id is not null and commit_sha is not null")
    return rows.select("repo_id", "commit_sha", F.lit(agent).alias("agent"), F.get_json_object("payload", "$.session_id").alias("session_id"), F.when(tool.isNotNull(), F.to_json(F.struct(tool.alias("tool")))).alias("metadata_json"))
