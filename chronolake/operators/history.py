"""Walks over commit graphs and per-line blame, for all repositories at once.

Walks work on parents (repo, sha, ord, parent). Repositories of ordinary size are handed to
one task each, sorted, and walked in memory there; in log_walk and merge_base, those of more than
`large` edges are walked level by level with joins. A max_depth of None is no limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.shared import cut

LARGE = 2_000_000


def _by_repo(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, list[str]], list[tuple]]]:
    """(repo, parents in order by commit, other rows) from rows sorted by repo: kind 0 edges, kind 1 others."""
    repo, edges, rows = None, {}, []
    for b in batches:
        for r, kind, a, n, p in zip(*(c.to_pylist() for c in b.columns)):
            if r != repo and (edges or rows):
                yield repo, edges, rows
                edges, rows = {}, []
            repo = r
            if kind:
                rows.append((a, n, p))
            else:
                known = edges.setdefault(a, [])
                if p is not None:
                    known.append((n, p))
    if edges or rows:
        yield repo, edges, rows


def _ordered(edges: dict) -> dict[str, list[str]]:
    return {k: [p for _, p in sorted(v)] for k, v in edges.items()}


def _walked(graph: DataFrame, rows: DataFrame, kernel: Callable, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for repo, edges, own in _by_repo(batches):
            out += ((repo, *x) for x in kernel(_ordered(edges), own))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    both = graph.select("repo", F.lit(0).alias("kind"), F.col("sha").alias("a"), F.col("ord").cast("long").alias("n"), F.col("parent").alias("p")).unionByName(rows)
    return both.repartition("repo").sortWithinPartitions("repo", "kind").mapInArrow(run, schema)


def _log_kernel(max_depth: int | None) -> Callable:
    def kernel(parents: dict[str, list[str]], seeds: list[tuple]) -> Iterator[tuple]:
        frontier = list(dict.fromkeys(s for s, _, _ in sorted(seeds, key=lambda x: x[1])))
        seen, depth = set(frontier), 0
        while frontier and (max_depth is None or depth <= max_depth):
            known = [s for s in frontier if s in parents]
            yield from ((s, depth, i) for i, s in enumerate(known))
            nxt = []
            for s in known:
                for p in parents[s]:
                    if p not in seen:
                        seen.add(p)
                        nxt.append(p)
            frontier, depth = nxt, depth + 1

    return kernel


def log_walk(parents: DataFrame, seeds: DataFrame, max_depth: int | None = 1000, large: int = LARGE) -> DataFrame:
    """(repo, sha, depth, pos): every commit that seeds (repo, sha, ord) reach, at its least distance, in the order of discovery.

    parents has a row per parent, and one with a null parent for a root. Seeds are taken once
    each; commits that parents does not hold vanish.
    """
    size = parents.groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    big = size.where(F.col("edges") > large).select("repo")
    many = not big.isEmpty()
    small = parents.join(big, "repo", "left_anti") if many else parents
    few = seeds.join(big, "repo", "left_anti") if many else seeds
    rows = few.select("repo", F.lit(1).alias("kind"), F.col("sha").alias("a"), F.col("ord").cast("long").alias("n"), F.lit(None).cast("string").alias("p"))
    out = _walked(small, rows, _log_kernel(max_depth), "repo string, sha string, depth long, pos long", ["repo", "sha", "depth", "pos"], [pa.string(), pa.string(), pa.int64(), pa.int64()])
    if many:
        out = out.unionByName(log_levels(parents.join(big, "repo", "left_semi"), seeds.join(big, "repo", "left_semi"), max_depth))
    return out


def log_levels(parents: DataFrame, seeds: DataFrame, max_depth: int | None = 1000) -> DataFrame:
    """log_walk level by level: a join per level, visited commits taken out by anti-joins."""
    known = parents.select("repo", "sha").distinct()
    w = Window.partitionBy("repo").orderBy("pos")
    level = seeds.groupBy("repo", "sha").agg(F.min("ord").cast("long").alias("pos"))
    seen = frontier = cut(level)
    found, depth = None, 0
    while (max_depth is None or depth <= max_depth) and not frontier.isEmpty():
        here = frontier.join(known, ["repo", "sha"], "left_semi").select("repo", "sha", F.lit(depth).cast("long").alias("depth"), (F.row_number().over(w) - 1).cast("long").alias("pos"))
        here = cut(here)
        found = here if found is None else found.unionByName(here)
        step = here.join(parents.where("parent is not null"), ["repo", "sha"]).groupBy("repo", "parent").agg(F.min(F.struct("pos", "ord")).alias("at"))
        new = step.withColumnRenamed("parent", "sha").join(seen, ["repo", "sha"], "left_anti")
        frontier = cut(new.select("repo", "sha", (F.row_number().over(Window.partitionBy("repo").orderBy("at")) - 1).cast("long").alias("pos")))
        seen = seen.unionByName(frontier)
        depth += 1
    return found if found is not None else level.select("repo", "sha", F.lit(0).cast("long").alias("depth"), "pos").limit(0)


def log(walked: DataFrame, commits: DataFrame, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """Commits of a walk in its order: those that keep holds for, at most limit (at least 1) per repository, with rank from 1.

    Commits that keep rules out are still walked through.
    """
    met = walked.join(commits, ["repo", "sha"])
    met = met if keep is None else met.where(keep)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("depth", "pos")).cast("long"))
    return ranked if limit is None else ranked.where(F.col("rank") <= max(1, limit))


def _topo_kernel(limit: int | None) -> Callable:
    def kernel(parents: dict[str, list[str]], rows: list[tuple]) -> Iterator[tuple]:
        """rows: heads (p is null) and times of commits (p is "t")."""
        import heapq

        times = {s: n for s, n, p in rows if p is not None}
        seen, stack = set(), [s for s, _, p in rows if p is None and s in parents]
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                stack += [p for p in parents[s] if p in parents]
        children = dict.fromkeys(seen, 0)
        for s in seen:
            for p in set(parents[s]) & seen:
                children[p] += 1
        ready = [(-(times.get(s) or 0), s) for s, n in children.items() if not n]
        heapq.heapify(ready)
        at = 0
        while ready and (limit is None or at < limit):
            _, s = heapq.heappop(ready)
            yield s, at
            at += 1
            for p in set(parents[s]) & seen:
                children[p] -= 1
                if not children[p]:
                    heapq.heappush(ready, (-(times.get(p) or 0), p))

    return kernel


def revwalk(parents: DataFrame, commits: DataFrame, heads: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, sha, pos): what heads (repo, sha) reach, children before parents, newer before older where both may come.

    commits: repo, sha, author_ts; equal times go by sha. limit: at most so many per repository.
    """
    none, text = F.lit(None).cast("string"), F.lit("t")
    rows = heads.select("repo", F.lit(1).alias("kind"), F.col("sha").alias("a"), F.lit(0).cast("long").alias("n"), none.alias("p"))
    rows = rows.unionByName(commits.select("repo", F.lit(1).alias("kind"), F.col("sha").alias("a"), F.col("author_ts").cast("long").alias("n"), text.alias("p")))
    return _walked(parents, rows, _topo_kernel(limit), "repo string, sha string, pos long", ["repo", "sha", "pos"], [pa.string(), pa.string(), pa.int64()])


def _reach_kernel(parents: dict[str, list[str]], max_depth: int | None) -> Callable[[str], dict[str, tuple[int, int]]]:
    """start -> {sha: (level, order of discovery)}; commits that parents does not hold are reached, but lead nowhere."""

    @lru_cache(maxsize=64)
    def reach(start: str) -> dict[str, tuple[int, int]]:
        found, level = {start: (0, 0)}, [start]
        while level and (max_depth is None or found[level[0]][0] < max_depth):
            depth = found[level[0]][0] + 1
            level = [p for p in dict.fromkeys(p for s in level for p in parents.get(s, ())) if p not in found]
            found |= {p: (depth, i) for i, p in enumerate(level)}
        return found

    return reach


def _base_kernel(max_depth: int | None, best: bool) -> Callable:
    def meeting(mine: tuple[int, int], other: tuple[int, int]) -> tuple:
        """When walks that go a level at a time, in turn, meet at a commit: the later level, whose turn it is, and the order in it."""
        return (mine[0], 0, mine[1]) if mine[0] > other[0] else (other[0], 1, other[1])

    def kernel(parents: dict[str, list[str]], pairs: list[tuple]) -> Iterator[tuple]:
        reach = _reach_kernel(parents, max_depth)
        for a, _, b in pairs:
            up, other = reach(a), reach(b)
            common = up.keys() & other.keys()
            if best:  # whatever a common commit descends from is common too
                common -= {p for s in common for p in parents.get(s, ())}
                yield a, b, min(common, key=lambda s: (up[s][0] + other[s][0], s), default=None)
            else:
                yield a, b, min(common, key=lambda s: meeting(up[s], other[s]), default=None)

    return kernel


def _reach_levels(parents: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """(repo, start, sha, depth, pos) of all that starts (repo, start) reach: a join per level, visited commits taken out by anti-joins."""
    edges = parents.where("parent is not null").select("repo", "sha", "ord", "parent")
    key, zero = ["repo", "start", "sha"], F.lit(0).cast("long")
    found = level = cut(starts.distinct().withColumn("sha", F.col("start")).withColumn("depth", zero).withColumn("pos", zero))
    depth = 0
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        step = level.join(edges, ["repo", "sha"]).groupBy("repo", "start", F.col("parent").alias("sha")).agg(F.min(F.struct("pos", "ord")).alias("at"))
        order = Window.partitionBy("repo", "start").orderBy("at")
        new = step.join(found, key, "left_anti").select(*key, F.lit(depth).cast("long").alias("depth"), (F.row_number().over(order) - 1).cast("long").alias("pos"))
        level = cut(new)
        found = found.unionByName(level)
    return found


def _base_levels(parents: DataFrame, pairs: DataFrame, max_depth: int | None, best: bool) -> DataFrame:
    """merge_base by joins: the least (level, side, order of discovery) of what both sides reach."""
    pairs = cut(pairs.select("repo", "a", "b").distinct())
    reach = _reach_levels(parents, pairs.select("repo", F.explode(F.array("a", "b")).alias("start")), max_depth)
    side = lambda name: reach.select("repo", F.col("start").alias(name), "sha", F.struct("depth", "pos").alias(f"of_{name}"))
    common = pairs.join(side("a"), ["repo", "a"]).join(side("b"), ["repo", "b", "sha"])
    if best:
        common = cut(common)
        above = common.join(parents.select("repo", "sha", "parent"), ["repo", "sha"]).select("repo", "a", "b", F.col("parent").alias("sha"))
        common = common.join(above, ["repo", "a", "b", "sha"], "left_anti")
        order = F.struct(F.col("of_a.depth") + F.col("of_b.depth"), "sha")
    else:
        late = F.col("of_a.depth") > F.col("of_b.depth")
        order = F.when(late, F.struct(F.col("of_a.depth"), F.lit(0).alias("side"), F.col("of_a.pos"))).otherwise(F.struct(F.col("of_b.depth"), F.lit(1).alias("side"), F.col("of_b.pos")))
    base = common.groupBy("repo", "a", "b").agg(F.min_by("sha", order).alias("base"))
    return pairs.join(base, ["repo", "a", "b"], "left")


def merge_base(parents: DataFrame, pairs: DataFrame, max_depth: int | None = 1000, best: bool = False, large: int = LARGE) -> DataFrame:
    """(repo, a, b, base) of pairs (repo, a, b); null where the two never meet.

    The default is the first meeting of both walks; best asks for a common ancestor that no
    other one descends from. Pairs of large repositories are answered once each.
    """
    big = parents.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > large).select("repo")
    many = not big.isEmpty()
    small, few = (x.join(big, "repo", "left_anti") if many else x for x in (parents, pairs))
    rows = few.select("repo", F.lit(1).alias("kind"), F.col("a"), F.lit(0).cast("long").alias("n"), F.col("b").alias("p"))
    out = _walked(small, rows, _base_kernel(max_depth, best), "repo string, a string, b string, base string", ["repo", "a", "b", "base"], [pa.string()] * 4)
    if many:
        out = out.unionByName(_base_levels(parents.join(big, "repo", "left_semi"), pairs.join(big, "repo", "left_semi"), max_depth, best))
    return out


def rev_parse(parents: DataFrame, refs: DataFrame, expression: str) -> DataFrame:
    """(repo, name, sha) of refs (repo, name, sha) after an expression of ~N, ^ and ^N, as in HEAD~2^2; null where there is none."""
    import re

    if not re.fullmatch(r"(~[0-9]*|\^[0-9]*)*", expression):
        raise ValueError(f"not an ancestry expression: {expression}")
    out = refs.select("repo", "name", "sha")
    edges = parents.where("parent is not null").select(F.col("repo").alias("r"), F.col("sha").alias("s"), F.col("ord").alias("o"), "parent")
    for op, digits in re.findall(r"([~^])([0-9]*)", expression):
        n = int(digits) if digits else 1
        for which in ([0] * n if op == "~" else [n - 1] if n else []):
            met = out.join(edges.where(F.col("o") == which), (F.col("repo") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
            out = met.select("repo", "name", F.col("parent").alias("sha"))
    return out


def first_parent_chain(parents: DataFrame, heads: DataFrame, max_depth: int | None = 1000) -> DataFrame:
    """(repo, head, depth, sha): each head's chain of first parents, by reach that doubles with each join."""
    jump = cut(parents.where("ord = 0 and parent is not null").select("repo", F.col("sha").alias("s"), F.col("parent").alias("to")))
    chain = heads.select("repo", F.col("sha").alias("head"), F.lit(0).cast("long").alias("depth"), "sha")
    step, max_depth = 1, jump.count() if max_depth is None else max_depth  # no chain is longer than there are edges
    while step <= max_depth and not jump.isEmpty():
        c, j = chain.alias("c"), jump.alias("j")
        further = c.join(j, (F.col("c.repo") == F.col("j.repo")) & (F.col("c.sha") == F.col("j.s"))).select("c.repo", "c.head", (F.col("c.depth") + step).alias("depth"), F.col("j.to").alias("sha"))
        chain = cut(chain.unionByName(further.where(F.col("depth") <= max_depth)))
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(a.join(b, (F.col("a.repo") == F.col("b.repo")) & (F.col("a.to") == F.col("b.s"))).select(F.col("a.repo").alias("repo"), F.col("a.s").alias("s"), F.col("b.to").alias("to")))
        step *= 2
    return chain


def blame(versions: DataFrame, max_depth: int | None = 1000) -> DataFrame:
    """(key, line_number, line, depth) for the version of depth 0 of each file: the depth that each line is attributed to.

    versions: key, depth, content (text; null where the file is missing), newest first. A line
    belongs to the last version of the unbroken run of versions, from the newest, that hold it.
    Versions beyond the first missing one do not count. One shuffle by (key, line); no iteration.
    """
    near = versions if max_depth is None else versions.where(F.col("depth") <= max_depth)
    w = Window.partitionBy("key").orderBy("depth")
    whole = near.withColumn("n", F.row_number().over(w) - 1).withColumn("gone", F.max(F.col("content").isNull().cast("int")).over(w)).where("gone = 0 and depth = n")
    lined = whole.select("key", "depth", C.split_lines(F.col("content"), "blame").alias("lines"))
    # lines of older versions travel as digests; the text comes from the newest version alone
    digest = lambda line: F.unhex(F.md5(line))
    held = lined.select("key", "depth", F.explode(F.array_distinct(F.transform("lines", digest))).alias("digest"))
    order = Window.partitionBy("key", "digest").orderBy("depth")
    run = held.withColumn("n", F.row_number().over(order) - 1).where("depth = n").groupBy("key", "digest").agg(F.max("depth").cast("long").alias("depth"))
    start = lined.where("depth = 0").select("key", F.posexplode("lines").alias("i", "line")).select("key", (F.col("i") + 1).cast("long").alias("line_number"), "line", digest(F.col("line")).alias("digest"))
    return start.join(run, ["key", "digest"]).select("key", "line_number", "line", "depth")


def blame_commits(versions: DataFrame, max_depth: int | None = 1000) -> DataFrame:
    """blame with the commit column of versions instead of depth."""
    found = blame(versions, max_depth)
    return found.join(versions.select("key", "depth", "commit"), ["key", "depth"]).select("key", "line_number", "line", "commit")


def log_by_path(versions: DataFrame) -> DataFrame:
    """The versions (key, n, sha; oldest first) in which a file's content changed, appeared or went away."""
    before = F.lag("sha").over(Window.partitionBy("key").orderBy("n"))
    return versions.withColumn("before", before).where(~F.col("sha").eqNullSafe(F.col("before"))).select("key", "n", "sha")
