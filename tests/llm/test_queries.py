"""The registered queries, those with SQL against it, and the pipeline stage by stage."""

import pytest

from chronolake.llm import queries

from . import cases


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import re
    from collections import Counter

    import corpus_pipeline as p

    from chronolake.llm import mixing, quality_classifier

    from .test_dedup import LOWER, brute_texts

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    now = docs
    for name, stage in p.STAGES:
        now = stage(spark, now, folder).cache()
        after[name] = now
        if name != p.STAGES[-1][0]:
            assert now.dtypes == docs.dtypes
    good, unique, apart, mixed, coded = after.values()
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= quality_classifier.THRESHOLD}
    last = {}
    for r in good.collect():
        key = r["text"].translate(LOWER)
        last[key] = max(last.get(key, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in unique.collect()} == set(last.values())
    found = brute_texts([(r["doc_id"], r["text"]) for r in unique.collect()], p.WORDS, p.NUM, p.DEN)
    assert {r["doc_id"] for r in apart.collect()} == {i for i, _, c, _ in found if i == c}
    counts = Counter(r["doc_id"] for r in mixing.mix(apart, mixing.PRODUCTION).collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == counts == Counter(r["doc_id"] for r in coded.collect())
    assert sorted((r["doc_id"], r["text"]) for r in coded.collect()) == sorted((r["doc_id"], r["text"] or "") for r in mixed.collect())
    assert all(re.fullmatch("[0-9]+", str(r["n_tokens"])) and len(r["ids"]) == r["n_tokens"] for r in coded.collect())


def labelled(spark, docs, good):
    return docs.selectExpr("doc_id", f"cast({good} as int) as quality").distinct()


@pytest.mark.parametrize("made", [cases.frame, cases.empty])
def test_pipeline_on_odd_tables(spark, made, tmp_path, monkeypatch):
    """Nulls, repeated rows, ties, clashing columns and no rows at all, through every stage in turn."""
    from collections import Counter

    import corpus_pipeline as p

    from .test_dedup import LOWER, components, shingles

    docs = made(spark)
    # a classifier that keeps everything but texts of symbols, so that odd rows reach the later stages
    labelled(spark, docs, "coalesce(text, '') not like '# $%'").where("doc_id is not null").write.parquet(str(tmp_path / "labels.parquet"))
    now, before = docs, {}
    for name, stage in p.STAGES:
        before[name] = [tuple(r) for r in now.collect()]
        now = stage(spark, now, str(tmp_path))
        if name != p.STAGES[-1][0]:
            assert now.dtypes == docs.dtypes, name
            path = str(tmp_path / name.replace(" ", "-"))
            now.write.parquet(path)
            now = spark.read.parquet(path)
    raw, good, unique, apart, mixed = before.values()
    assert not Counter(good) - Counter(raw)
    key = lambda r: (r[1] or "").translate(LOWER)
    last = {}
    for r in good:
        last[key(r)] = max(last.get(key(r), r[0]), r[0], key=lambda i: (i is not None, i or 0))
    assert Counter((key(r), r[0]) for r in unique) == Counter(last.items())
    sets = [(r[0], shingles(r[1], p.WORDS)) for r in unique]
    live = [s for i, s in sets if i is not None and s]
    tied = [(a, b) for a, s in enumerate(live) for b, t in enumerate(live[:a]) if len(s & t) * p.DEN >= p.NUM * len(s | t)]
    of_component = components([*tied, *((a, a) for a in range(len(live)))])
    assert len(apart) == len(unique) - len(live) + len(set(of_component.values())) < len(unique) or not raw
    assert not Counter(apart) - Counter(unique)
    assert set(mixed) <= set(apart)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in now.collect()) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in mixed)
