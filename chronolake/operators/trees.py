"""Trees of files: flattening, resolving paths, comparing and rewriting snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.udfs import parse_tree
from ..plans.shared import cut
from .text import diff_blobs, pair_by_sha

EMPTY_SHA = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # of a tree without entries


def walk_trees(objects: DataFrame) -> DataFrame:
    """(sha, ord, mode, name, entry_sha) of all tree objects (sha, type, content); others are dropped."""
    trees = objects.where("type = 'tree'").select("sha", parse_tree("content").alias("entries"))
    return trees.select("sha", F.inline("entries")).toDF("sha", "ord", "mode", "name", "entry_sha")


def flatten(entries: DataFrame, roots: DataFrame, max_depth: int = 256) -> DataFrame:
    """(root, path, mode, sha) of all files below roots (root, tree_sha); entries: tree_sha, mode, name, sha. A join per level."""
    level = roots.select("root", F.lit("").alias("prefix"), "tree_sha")
    files, depth = None, 0
    rows = entries.select("tree_sha", "mode", "name", "sha")
    while True:
        met = cut(level.join(rows, "tree_sha").select("root", F.concat("prefix", "name").alias("path"), "mode", "sha"))
        own = met.where(~C.is_dir(F.col("mode")))
        files = own if files is None else files.unionByName(own)
        below = met.where(C.is_dir(F.col("mode")))
        depth += 1
        if below.isEmpty():
            return files
        if depth > max_depth:
            raise ValueError("trees are nested too deeply")
        level = below.select("root", F.concat("path", F.lit("/")).alias("prefix"), F.col("sha").alias("tree_sha"))


def resolve(entries: DataFrame, wanted: DataFrame, max_parts: int = 256) -> DataFrame:
    """(root, path, sha, mode) of files that wanted (root, tree_sha, path) names; null sha where there is none.

    All parts but the last have to be directories, and the last none.
    """
    parts = cut(wanted.select("root", "path", "tree_sha", C.split_path(F.col("path")).alias("parts")))
    most = parts.agg(F.max(F.size("parts"))).first()[0] or 0
    if most > max_parts:
        raise ValueError("a path has too many parts")
    at = parts.select("root", "path", "parts", "tree_sha", F.lit(None).cast("string").alias("mode"))
    rows = entries.select(F.col("tree_sha").alias("t"), F.col("name").alias("part"), F.col("mode").alias("m"), F.col("sha").alias("s"))
    for i in range(most):
        more = F.size("parts") > i
        ok = (F.col("tree_sha") == F.col("t")) & (F.get("parts", F.lit(i)) == F.col("part"))
        met = at.join(rows, ok, "left")
        fits = C.is_dir(F.col("m")) == (F.size("parts") > i + 1)
        at = met.select("root", "path", "parts", F.when(~more, F.col("tree_sha")).when(fits, F.col("s")).alias("tree_sha"), F.when(~more, F.col("mode")).when(fits, F.col("m")).alias("mode"))
    return at.select("root", "path", F.when(F.size("parts") > 0, F.col("tree_sha")).alias("sha"), "mode")


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, old_sha, new_sha) of entries (keys, sha) that differ: added, deleted or modified."""
    both = old.select(*keys, F.col("sha").alias("old_sha")).join(new.select(*keys, F.col("sha").alias("new_sha")), keys, "full")
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "modified")
    return both.withColumn("status", status).where("status is not null").select(*keys, "status", "old_sha", "new_sha")


def merge_snapshots(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sha, conflict) of a three-way merge; where both sides changed an entry differently, theirs is taken."""
    sides = [df.select(*keys, F.col("sha").alias(n)) for df, n in ((base, "b"), (ours, "o"), (theirs, "t"))]
    all_ = sides[0].join(sides[1], keys, "full").join(sides[2], keys, "full")
    b, o, t = map(F.col, "bot")
    same = lambda x, y: x.eqNullSafe(y)
    conflict = ~same(o, b) & ~same(t, b) & ~same(o, t)
    sha = F.when(same(t, b), o).otherwise(t)
    return all_.select(*keys, sha.alias("sha"), conflict.alias("conflict")).where(F.col("sha").isNotNull() | F.col("conflict"))


def cherry_pick(before: DataFrame, commit: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """head with what commit changed against the snapshot before it; as merge_snapshots."""
    return merge_snapshots(before, head, commit, keys)


def revert(before: DataFrame, commit: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """head without what commit changed against the snapshot before it; as merge_snapshots."""
    return merge_snapshots(commit, head, before, keys)


def diff(old: DataFrame, new: DataFrame, blobs: DataFrame, context: int = 3) -> DataFrame:
    """Patches between two snapshots (path, sha) with the contents of blobs (sha, content): only files that differ are read."""
    changes = compare(old, new, ["path"])
    return diff_blobs(pair_by_sha(changes, blobs), context)


def checkout(entries: DataFrame, roots: DataFrame, blobs: DataFrame) -> DataFrame:
    """(root, path, mode, type, content) of the files below roots, for write_worktree; files without content are left out."""
    files = flatten(entries, roots)
    return files.join(blobs.select("sha", "content"), "sha").select("root", "path", "mode", F.lit("blob").alias("type"), "content")


def build(files: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(root trees, all tree objects) of files (roots, path, mode, sha).

    Trees are made level by level from the deepest directory up: each level is one groupBy on
    the parent directory. Root trees: roots, sha. Objects: roots, path (of the directory), sha, content.
    """
    parts = C.split_path(F.col("path"))
    rows = cut(files.select(*roots, parts.alias("parts"), "mode", "sha"))
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    objects, made = None, None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.size("parts") == depth)
        if made is not None:
            here = here.unionByName(made)
        parent = F.slice("parts", 1, F.size("parts") - 1)
        entry = F.struct("mode", F.element_at("parts", -1).alias("name"), "sha")
        trees = here.groupBy(*roots, parent.alias("parts")).agg(C.encode_tree(F.collect_list(entry)).alias("content"))
        trees = cut(trees.select(*roots, "parts", C.object_id("tree", F.col("content")).alias("sha"), "content"))
        objects = trees if objects is None else objects.unionByName(trees)
        made = trees.select(*roots, "parts", F.lit("40000").alias("mode"), "sha")
    if objects is None:
        empty = rows.select(*roots, F.lit("").alias("path"), F.lit(EMPTY_SHA).alias("sha"), F.unhex(F.lit("")).alias("content")).limit(0)
        return empty.select(*roots, "sha"), empty
    named = objects.select(*roots, F.array_join("parts", "/").alias("path"), "sha", "content")
    return named.where("path = ''").select(*roots, "sha"), named


def change_paths(files: DataFrame, changes: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copy-on-write update of snapshots: (root trees, new objects, files after it).

    files: roots, path, mode, sha. changes: roots, path, mode, content (null content deletes;
    one change per path). New objects are the blobs and trees that the old snapshots do not
    hold: sha, type, content. Missing directories appear, empty ones vanish, and deleting what is
    not there changes nothing. A path through a file is an error.
    """
    norm = lambda df: df.withColumn("path", F.array_join(C.split_path(F.col("path")), "/"))
    old, new = cut(norm(files)), cut(norm(changes))
    if not new.where("path = ''").isEmpty():
        raise ValueError("a change needs a path")
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/"))
    parents = lambda df: df.where(F.size(F.split("path", "/")) > 1).select(*roots, F.explode(above).alias("path")).distinct()
    blobs = new.where("content is not null").withColumn("sha", C.object_id("blob", F.col("content")))
    after = cut(old.join(new.select(*roots, "path"), [*roots, "path"], "left_anti").unionByName(blobs.select(*old.columns)))
    if not parents(new).join(old.select(*roots, "path"), [*roots, "path"], "left_semi").isEmpty() or not parents(after).join(blobs.select(*roots, "path"), [*roots, "path"], "left_semi").isEmpty():
        raise ValueError("a path leads through a file")
    _, before = build(old, roots)
    tops, trees = build(after, roots)
    snapshots = files.select(*roots).distinct()
    tops = snapshots.join(tops, roots, "left").select(*roots, F.coalesce("sha", F.lit(EMPTY_SHA)).alias("sha")).unionByName(tops.join(snapshots, roots, "left_anti"))
    made = trees.select("sha", F.lit("tree").alias("type"), "content").dropDuplicates(["sha"]).join(before.select("sha"), "sha", "left_anti")
    own = blobs.select("sha", F.lit("blob").alias("type"), "content").dropDuplicates(["sha"])
    return tops, made.unionByName(own), after


def commit_change(heads: DataFrame, tops: DataFrame, repo: str, name: Column, email: Column, seconds: Column, message: Column) -> DataFrame:
    """New commits on heads (repo, ref, sha; null sha: a new branch) for root trees (repo, sha): repo, ref, old_sha, new_sha, content."""
    met = heads.withColumnRenamed("sha", "parent").join(tops.withColumnRenamed("sha", "tree"), repo)
    parents = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>"))
    body = F.encode(C.encode_commit(F.col("tree"), parents, name, email, seconds, message), "UTF-8")
    return met.withColumn("content", body).select(repo, "ref", F.coalesce("parent", F.lit("0" * 40)).alias("old_sha"), C.object_id("commit", F.col("content")).alias("new_sha"), "content")
