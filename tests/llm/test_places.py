from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from geotext.llm import common, suffix_levels
from geotext.llm.chunk_recipes import drop_copies, find_copies
from geotext.llm.common import placed
from geotext.llm.popcount_simhash import drop_near_copies
from geotext.llm.suffix_levels import remove_repeats

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def files(spark, tmp_path):
    """Copies spread over six files, with columns named as those that the operators add."""
    texts = [f"text {i % 50} " + "word of some length " * (i % 7) for i in range(400)]
    rows = [(i, t, 77, f"f{i}", i * 2, "k", t[:3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_tag int, _found string, _judged long, _key string, _text string")
    docs.repartition(6).write.parquet(str(tmp_path / "docs"))
    yield spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.unset(SPLITS)


@pytest.fixture
def moving(spark, monkeypatch):
    """Scans are split another way after each stored step of a call."""
    seen = []
    for module in (common, __import__("geotext.llm.chunk_recipes", fromlist=["x"]), __import__("geotext.llm.popcount_simhash", fromlist=["x"]), suffix_levels):

        def change(df, old=module.cut):
            out = old(df)
            seen.append(out)
            spark.conf.set(SPLITS, str(1 + 7 * len(seen) % 12))
            return out

        monkeypatch.setattr(module, "cut", change)
    return seen


def test_numbers_do_not_depend_on_splits(spark, files):
    spark.conf.set(SPLITS, "2")
    few = {r.doc_id: r.n for r in placed(files, "n").select("doc_id", "n").collect()}
    spark.conf.set(SPLITS, "24")
    assert few == {r.doc_id: r.n for r in placed(files, "n").where("doc_id >= 0").select("doc_id", "n").collect()}
    assert len(set(few.values())) == 400


def test_what_is_no_plain_scan_is_stored_first(files):
    twice = files.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("_metadata"))
    got = placed(twice)
    assert got.columns == ["doc_id", "_metadata", "row_tag"] and got.select("row_tag").distinct().count() == 800
    assert placed(files.union(files).select("doc_id")).select("row_tag").distinct().count() == 800
    assert drop_copies(files.union(files)).select("text").distinct().count() == drop_copies(files.union(files)).count()


@pytest.mark.parametrize("drop", [drop_copies, drop_near_copies])
def test_drops_while_splits_change(spark, files, moving, drop):
    everything = {r.doc_id: r for r in files.collect()}
    first = {}
    for i in sorted(everything):
        first.setdefault(everything[i].text, i)
    got = drop(files)
    assert got.columns == files.columns
    got = {r.doc_id: r for r in got.collect()}
    assert moving and all(got[i] == everything[i] for i in got)
    if drop is drop_copies:
        assert sorted(got) == sorted(first.values())
        assert sum(r.kept for r in find_copies(files).collect()) == len(first)
    else:
        assert 0 < len(got) <= len(first) and set(got) <= set(first.values())


def test_repeats_while_splits_change(spark, files, moving):
    def rows():
        return sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in remove_repeats(files, length=40, prefix=16).collect())

    first = rows()
    spark.conf.unset(SPLITS)
    assert moving and first == rows()
    # Everything of 40 bytes and more is a copy of some other text.
    by_id = {r.doc_id: r.text for r in files.collect()}
    assert all(n == len(by_id[i]) for i, n, _ in first if len(by_id[i]) >= 40)
