from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geotext.llm import kneser_ney
from geotext.llm.common import crc_share, table
from test_popcount_simhash import brute as near_brute
from test_two_fit import check_placed
from test_window_search import brute as window_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before the first stage and what each stage returned, read again."""
    folder, docs = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_names_and_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    for docs in steps[1:-1]:
        assert docs.dtypes == steps[0].dtypes


def kept(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_toxicity_keeps_what_is_not_predicted(spark, steps):
    before, after = steps[0], kept(steps[1])
    scored = kneser_ney.score_toxicity(before, table(spark, SF, "labels"), learn=crc_share(F.col("doc_id"), 3) != 1)
    assert set(after) == {r.doc_id for r in scored.collect() if not r.predicted}


def test_exact_dedup(steps):
    before, first = kept(steps[1]), {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text), i)
    assert set(kept(steps[2])) == set(first.values())


def test_near_dedup(steps):
    before = kept(steps[2])
    rows = near_brute([(i, r.text) for i, r in before.items()])
    assert set(kept(steps[3])) == {component for _, _, component in rows}


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {i for i, r in kept(steps[3]).items() if window_brute(r.text, items)[1] == 0}
    assert set(kept(steps[4])) == clean


def test_packing_and_run(spark, steps):
    placed = steps[5].collect()
    assert {r.doc_id for r in placed} == set(kept(steps[4]))
    n = check_placed(placed, 4096)
    assert n == -(-sum(r.length for r in placed) // 4096)
    whole = corpus_pipeline.run(spark, SF).collect()
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert pieces(whole) == pieces(placed)


@pytest.mark.parametrize("stage", range(5))
def test_empty_and_odd_documents(spark, tmp_path, stage):
    name, function = corpus_pipeline.STAGES[stage]
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "x", 0), (900, "", "en", "x", 0)], docs.schema)
    odd.coalesce(1).write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    want = {"toxicity": 3, "exact_dedup": 1, "near_dedup": 1, "decontaminate": 3, "packing": 3}
    assert len(function(spark, odd, SF).collect()) == want[name]
    assert function(spark, odd.where(F.lit(False)), SF).count() == 0
