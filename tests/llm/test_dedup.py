"""Exact dedup, the Jaccard join and repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.llm import exact_dedup, graph, jaccard, repeats

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- the index -------------------------------------------------------------------------------


def test_cuckoo_index_holds_deletes_and_grows():
    index = exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert k not in index
        index.insert(k, i)
    assert index.resizes and len(index) == 3000 and all(index.values[index.find(k)] == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert len(index) == 1500 and [k in index for k in keys] == [i % 2 == 1 for i in range(3000)]
    for i, k in enumerate(keys[::2]):
        index.insert(k, -i)
    assert len(index) == 3000 and dict(index.items())[keys[4]] == -2


def test_hits_are_verified():
    """Keys with one fingerprint and one bucket are told apart, and deleting one spares the other."""
    index = exact_dedup.CuckooIndex(4)
    a, b = b"\1\2" + b"\0" * 5 + b"\3" + b"a" * 24, b"\1\2" + b"\0" * 5 + b"\3" + b"b" * 24
    index.insert(a, 1)
    assert b not in index
    index.insert(b, 2)
    index.delete(a)
    assert a not in index and b in index


def test_exact_dedup(spark):
    data = cases.rows()
    got = exact_dedup.exact_dedup(cases.frame(spark)).collect()
    norm = lambda t: (t or "").translate(LOWER)
    groups = defaultdict(list)
    for i, t, _, _ in data:
        groups[norm(t)].append(i)
    want = Counter((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _, _ in data)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_copies_go_and_columns_stay(spark):
    df = cases.frame(spark)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    norm = [(r["text"] or "").translate(LOWER) for r in rows]
    assert len(norm) == len(set(norm)) == len({(t or "").translate(LOWER) for _, t, _, _ in cases.rows()})


def test_combining_hands_on_what_is_full(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMBINE_KEYS", 3)
    test_exact_dedup(spark)


def test_live_digests_follow_documents(spark):
    key = lambda x: bytearray(hashlib.sha256(x.encode()).digest())
    rows = lambda x: spark.createDataFrame([(key(c),) for c in x], "digest binary")
    index = exact_dedup.update_index(None, rows("aabc"), buckets=2)
    index = exact_dedup.update_index(index, rows("cd"), rows("abbz"), buckets=2)
    assert {bytes(r["digest"]): r["copies"] for r in index.collect()} == {bytes(key("a")): 1, bytes(key("c")): 2, bytes(key("d")): 1}


def test_empty_tables(spark):
    e = cases.empty(spark)
    assert exact_dedup.exact_dedup(e).count() == exact_dedup.drop_copies(e).count() == 0
    assert jaccard.jaccard_components(e).count() == 0
    assert repeats.remove_repeats(e).count() == 0


# --- components ------------------------------------------------------------------------------


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(500, 500)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {k: v for k, v in components([e for e in edges if e[0] != e[1]]).items()}


# --- similarity ------------------------------------------------------------------------------


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[i:] for i in range(k))))


def near_copies():
    """A family of near copies at all distances, beside the odd cases."""
    r = random.Random(6)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    out = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randrange(0, 7)):
            words[r.randrange(len(words))] = f"x{r.randrange(99)}"
        out.append((1000 + i, " ".join(words[r.randrange(0, 8) :]), "en", "src0"))
    for i in range(60):
        out.append((2000 + i, " ".join(f"s{r.randrange(4)}" for _ in range(r.randrange(1, 14))), "en", "src0"))
    return out


def brute_texts(data, k, num, den):
    """doc_id, shingles, smallest doc_id of the component and links of each row; texts are linked each by itself."""
    sets = [(i, shingles(t, k)) for i, t, *_ in data]
    rows = Counter(s for i, s in sets if i is not None and s)
    live = list(rows)
    edges = [(a, b) for a, s in enumerate(live) for b, t in enumerate(live[:a]) if len(s & t) * den >= num * len(s | t)]
    root = components([*edges, *((a, a) for a in range(len(live)))])
    of = {s: root[a] for a, s in enumerate(live)}
    links = {s: n - 1 for s, n in rows.items()}
    for a, b in edges:
        links[live[a]] += rows[live[b]]
        links[live[b]] += rows[live[a]]
    least = {}
    for i, s in sets:
        if i is not None and s:
            least[of[s]] = min(i, least.get(of[s], i))
    return Counter((i, len(s), None if i is None else least[of[s]] if s else i, links[s] if s and i is not None else 0) for i, s in sets)


def shared_ids():
    """Texts of several rows to a doc_id, beside other documents with the same sets or near ones; doc_id 12 too."""
    r = random.Random(8)
    extra = near_copies()
    ids = [i for i, *_ in extra]
    again = [(r.choice(ids), t, lang, s) for _, t, lang, s in r.sample(extra, 90)]
    far = [" ".join(f"{name}{i}" for i in range(40)) for name in "pqr"]
    mixed = [(5000, far[0]), (5000, far[1]), (5009, far[1]), (5010, far[1] + " end"), (5011, far[0] + " end"), (4999, far[2]), (5000, far[2] + " end"), (5000, far[0]), (5000, far[0])]
    return [x for x in cases.rows([*extra, *again]) if x[0] != 16] + [(i, t, "en", "a") for i, t in mixed]


def joined(spark, data, *args):
    got = jaccard.jaccard_join(cases.frame(spark, data), *args).collect()
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got)


def without_links(found):
    out = Counter()
    for (*row, _), n in found.items():
        out[tuple(row)] += n
    return out


@pytest.mark.parametrize("k, num, den, size", [(3, 90, 100, 900), (5, 80, 100, 1500), (2, 60, 100, jaccard.CLUSTER_SHINGLES)])
def test_jaccard(spark, k, num, den, size):
    data = [x for x in cases.rows(near_copies()) if x[0] != 16] + [(16, cases.long_text(3000), "en", "a")]
    wanted = brute_texts(data, k, num, den)
    assert joined(spark, data, k, num, den, size) == wanted
    rows = jaccard.jaccard_rows(cases.frame(spark, data), k, num, den, size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == without_links(wanted)


@pytest.mark.parametrize("k, num, den, size", [(3, 90, 100, jaccard.CLUSTER_SHINGLES)])
def test_texts_of_one_doc_id_are_linked_each_by_itself(spark, k, num, den, size):
    data = shared_ids()
    assert joined(spark, data, k, num, den, size) == brute_texts(data, k, num, den)


def test_two_texts_of_a_doc_id_tie_two_others(spark):
    far = [" ".join(f"{name}{i}" for i in range(60)) for name in "ab"]
    data = [(5, far[0], "en", "a"), (5, far[1], "en", "a"), (1, far[0] + " end", "en", "a"), (2, far[1] + " end", "en", "a")]
    assert joined(spark, data) == brute_texts(data, 3, 90, 100) == Counter({(5, 58, 1, 1): 1, (1, 59, 1, 1): 1, (5, 58, 2, 1): 1, (2, 59, 2, 1): 1})


def test_components_start_from_links_that_are_written(spark, monkeypatch):
    """Where clusters have many blocks: two Python workers to a task would keep their memory through all that follows."""
    seen = []
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(edges._jdf.queryExecution().executedPlan().toString()) or graph.components(edges))
    data = [x for x in cases.rows(near_copies()) if x[0] != 16]
    rows = jaccard.jaccard_components(cases.frame(spark, data), 5, 80, 100, 1500).collect()
    assert Counter(map(tuple, rows)) == without_links(brute_texts(data, 5, 80, 100))
    assert len(seen) > 2 and not [plan for plan in seen if "MapInArrow" in plan]


def test_one_text_of_a_component_stays(spark):
    """A doc_id of two texts, one of which has a copy of a smaller doc_id, loses that one alone."""
    import corpus_pipeline

    far = [" ".join(f"{name}{i}" for i in range(60)) for name in "pqr"]
    data = [(4, far[0]), (5, far[0] + " end"), (5, far[1]), (7, far[1] + " end"), (8, far[2]), (8, far[2] + " end"), (None, far[2]), (9, None)]
    kept = corpus_pipeline.near(spark, cases.frame(spark, [(i, t, "en", "a") for i, t in data]), "").collect()
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    either = got[8, far[2]] + got[8, far[2] + " end"]
    assert either == 1 and Counter({k: n for k, n in got.items() if k[0] != 8}) == Counter([(4, far[0]), (5, far[1]), (None, far[2]), (9, None)])


def test_a_common_passage_makes_no_large_cluster(spark):
    """Pairs of near copies that all hold one passage are one cluster by their ties, and pairs again before they are dealt out."""
    r = random.Random(6)
    passage, data = [f"p{i}" for i in range(40)], []
    for i in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)] + passage
        data += [(2 * i, " ".join(words), "en", "a"), (2 * i + 1, " ".join([*words, "end"]), "en", "a")]
    docs = cases.frame(spark, data)
    for k, num, den in ((3, 90, 100), (5, 80, 100)):
        _, nodes, sets = jaccard._clustered(docs, k, num, den, 1000)
        found = sets.groupBy("cluster", "blocks").count().collect()
        assert sum(r["count"] for r in found) == 80 and all(r["count"] <= 6 and r["blocks"] == 1 for r in found)
        assert joined(spark, data, k, num, den, 1000) == brute_texts(data, k, num, den)


def test_sets_of_a_large_cluster_are_not_sent_ever_more_often(spark):
    got = spark.createDataFrame([(300, 2), (20_000, 40), (900_000, 2000), (20_000_000, 50_000)], "n long, nodes long").select(jaccard._n_blocks(F.col("n"), F.col("nodes"), 1000)).collect()
    assert [r[0] for r in got] == [1, 12, 12, 24]


def test_blocks_of_a_task_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 700)
    data = cases.rows(near_copies()[:60])
    assert joined(spark, data, 3, 90, 100, 900) == brute_texts(data, 3, 90, 100)


@pytest.mark.parametrize("num, den", [(90, 100), (80, 100), (1, 2)])
def test_dealing_loses_no_pair(num, den):
    """Sets that are similar enough share as many of their parts as both ask for, whatever their sizes."""
    r = np.random.default_rng(3)
    tried = 0
    ranges = jaccard.SizeRanges(num, den)
    for _ in range(600):
        n = int(r.integers(1, 300)) if r.random() < 0.7 else int(r.integers(1, 12))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        most = max(1, n * (den - num) // den)
        drop, add = int(r.integers(0, most + 1)), int(r.integers(0, most + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, add).astype(np.uint64)]))
        if not len(b) or np.array_equal(a, b) or len(np.intersect1d(a, b)) * den < num * len(np.union1d(a, b)):
            continue
        tried += 1
        part, of, name, need = jaccard._probes([1, 2], [a, b], ranges)
        assert len(set(name.tolist())) == len(name)
        tied = []
        for i in range(len(name)):
            for j in range(len(name)):
                if name[i] >> 2 == 1 and name[j] >> 2 == 2:
                    common = len(np.intersect1d(part[of == i], part[of == j]))
                    tied.append(common >= need[i] and common >= need[j] and common > 0)
        assert any(tied)
    assert tried > 50


def test_signature_tree_prunes_no_link():
    r = np.random.default_rng(5)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(r.choice(pool, int(r.integers(1, 120)))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: -max(1, len(s) // 20)], s[:1]])) for s in sets[:60] if len(s) > 20]
    labels, _ = jaccard.link(sets, 80, 100)
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 10 >= 8 * len(np.union1d(sets[i], sets[j]))]
    root = components([*edges, *((i, i) for i in range(len(sets)))])
    assert labels == [root[i] for i in range(len(sets))]
    _, links = jaccard.link(sets, 80, 100, weights=[1] * len(sets))
    assert links.tolist() == [sum(i in e for e in edges) for i in range(len(sets))]
    _, links = jaccard.link(sets, 80, 100, left=70, weights=[1] * len(sets))
    assert links.tolist() == [sum(i in e and (e[0] < 70) != (e[1] < 70) for e in edges) for i in range(len(sets))]
    tree = jaccard.SignatureTree(sets)
    tried = sum(len(a) for a, _ in jaccard.candidates(tree, tree, 80, 100))
    assert len(edges) <= tried < len(sets) ** 2 / 20


# --- repeated strings ------------------------------------------------------------------------


def brute_repeats(data, length):
    """Rows in the order of documents; rows of one id in any order are tried by the caller."""
    seen, out = set(), []
    for i, text in data:
        b = (text or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = sum(1 for j in range(len(mask)) if mask[j] and (not j or not mask[j - 1]))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df, length):
    return Counter(tuple(r) for r in repeats.digest(repeats.remove_repeats(df, length)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def passages():
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    cut = lambda: base[(a := r.randrange(2700)) : a + r.randrange(20, 400)] + r.choice(["", "x", "yy" * 40])
    data = [(i, "".join(cut() for _ in range(r.randrange(1, 6)))) for i in range(150)]
    return data + [(900, "a" * 1000), (901, "a" * 300 + "b" + "a" * 300), (902, ""), (903, None), (904, "ab" * 500), (905, "z" * 99), (906, "z" * 100), (907, "z" * 100), (908, "é" * 60), (909, "xé" + "é" * 60)]


@pytest.mark.parametrize("hot, scan, sort, length", [(2000, 4 << 20, 1 << 20, 100), (2, 4 << 20, 1 << 20, 100), (2000, 2000, 3000, 100), (2, 900, 500, 64), (2000, 4 << 20, 1 << 20, 200)])
def test_repeats(spark, monkeypatch, hot, scan, sort, length):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SCAN_BYTES", scan)
    monkeypatch.setattr(repeats, "SORT_BYTES", sort)
    data = passages()
    shuffled = random.Random(9).sample(data, len(data))
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in shuffled], "doc_id long, text string, key string, digest string")
    assert found(df, length) == brute_repeats(data, length)


def test_repeats_of_odd_tables(spark):
    """Rows of one doc_id come one after another, null ids last; texts of many pieces."""
    data = [(i, t) for i, t, _, _ in cases.rows() if i != 12]
    data = sorted(((i, t) for i, t in data if i is not None), key=lambda x: x[0]) + [(None, t) for i, t in data if i is None]
    got = found(cases.frame(spark, [(i, t, "en", "s") for i, t in data]), 100)
    # the null rows' own order follows a hash of their texts, which do not overlap but with earlier ones
    assert got == brute_repeats(data, 100)


def test_difference_cover():
    assert all(0 <= repeats.SHIFT[r, s] < repeats.V and (r + repeats.SHIFT[r, s]) % repeats.V in repeats.COVER and (s + repeats.SHIFT[r, s]) % repeats.V in repeats.COVER for r in range(repeats.V) for s in range(repeats.V))


def test_length_bounds(spark):
    for bad in (20, 600):
        with pytest.raises(ValueError):
            repeats.remove_repeats(cases.empty(spark), bad)


def test_a_live_digest_is_not_inserted_again():
    index = exact_dedup.CuckooIndex(2)
    index.insert(b"k" * 32, 1)
    with pytest.raises(ValueError):
        index.insert(b"k" * 32, 2)
    assert len(index) == 1 and index.resizes == 0


def test_an_index_that_names_a_digest_twice(spark):
    key = bytes(range(32))
    old = spark.createDataFrame([(5, key, 1)] * 9, "bucket long, digest binary, copies long").withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(16)))
    more = spark.createDataFrame([(key,)], "digest binary")
    assert [(bytes(r["digest"]), r["copies"]) for r in exact_dedup.update_index(old, more, buckets=16).collect()] == [(key, 10)]


def test_merging_a_stretch_of_digests_at_a_time(spark, monkeypatch):
    data = cases.rows()
    whole = sorted(exact_dedup.exact_dedup(cases.frame(spark, data)).collect(), key=repr)
    monkeypatch.setattr(exact_dedup, "COMBINE_KEYS", 3)
    assert sorted(exact_dedup.exact_dedup(cases.frame(spark, data)).collect(), key=repr) == whole
