"""Every query that has SQL gives the same rows on the smallest tables."""

import pytest

from chronolake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_patches_turn_old_into_new(spark):
    """Applying each hunk of a patch to the old text gives the new one."""
    from chronolake.plans.model import blob_pairs

    rows = catalog.QUERIES["X13_diff_patch"](spark, "/root/testdata/sf0.001").select("path", "patch").collect()
    pairs = {r["path"]: (bytes(r["old_content"] or b"").decode(), bytes(r["new_content"] or b"").decode()) for r in blob_pairs(spark, "/root/testdata/sf0.001").collect()}
    from tests.test_diff import apply_patch

    for path, patch in rows:
        old, new = pairs[path]
        assert apply_patch(old, patch) == new
