from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotext.llm import suffix_levels
from geotext.llm.common import table
from geotext.llm.suffix_levels import SuffixLevels, anchors_of, remove_repeats, sliding_least

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    datas = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[p : p + length] for _, d in datas for p in range(len(d) - length + 1))
    out = []
    for i, d in datas:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((gone[1:] < gone[:-1]).sum())
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def result(frame):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in frame.collect())


def inputs(seed, length):
    maker = random.Random(seed)
    noise = lambda n: "".join(maker.choice("abcdé ") for _ in range(n))
    passages = [noise(maker.randrange(length - 3, 3 * length)) for _ in range(6)]
    texts = [None, "", "ab", noise(length), "x" * (4 * length), "ab" * (2 * length), passages[0][:length], passages[0][1 : length + 1]]
    for _ in range(50):
        texts.append("".join(maker.choice([noise(maker.randrange(length)), maker.choice(passages)]) for _ in range(maker.randrange(1, 6))))
    base = noise(20 * length)
    texts += [base] * 5
    for _ in range(40):  # near copies: one anchor, many contexts
        at = maker.randrange(len(base))
        texts.append(base[:at] + maker.choice("XYZ") + base[at + 1 :])
    return list(enumerate(texts)) + [(3, texts[3]), (None, noise(2 * length))]


@pytest.fixture
def stored(spark, tmp_path):
    def store(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("mine"))
        docs.coalesce(3).write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs"))

    return store


@pytest.mark.parametrize(("group_contexts", "batches"), [(256, 5), (4, 1)])
def test_against_brute(stored, group_contexts, batches):
    rows = inputs(group_contexts, 40)
    docs = stored(rows)
    got = remove_repeats(docs, length=40, prefix=16, batches=batches, group_contexts=group_contexts)
    assert result(got) == brute(rows, 40)
    for r in got.collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_production_length(stored):
    rows = inputs(1, 400)[:40]
    assert result(remove_repeats(stored(rows))) == brute(rows, 400)


def test_anchors_across_stretches(monkeypatch):
    maker = random.Random(5)
    data = bytes(maker.randrange(97, 101) for _ in range(3000))
    whole = [p for _, first, last, _ in anchors_of(data, 40, 16) for p in range(first, last + 1)]
    assert whole == list(range(2961))
    monkeypatch.setattr(suffix_levels, "STRETCH", 100)
    split = {p: (h, anchor) for h, first, last, anchor in anchors_of(data, 40, 16) for p in range(first, last + 1)}
    monkeypatch.undo()
    assert split == {p: (h, a) for h, first, last, a in anchors_of(data, 40, 16) for p in range(first, last + 1)}


def test_sliding_least():
    keys = np.random.default_rng(3).integers(0, 50, 101, dtype=np.uint64)
    for width in (1, 2, 7, 100, 101):
        assert sliding_least(keys, width).tolist() == [min(keys[i : i + width]) for i in range(102 - width)]


def test_levels_double(spark):
    family = SuffixLevels()
    sizes = []
    for i in range(5):
        batch = spark.createDataFrame([(i * 10 + j,) for j in range(4)] + [(999,)], "h long")
        matches = {r.h for r in family.add(batch).collect()}
        assert matches == ({999} if i else set())
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    assert family.levels[2].where("h = 999").first().n == 4


def test_query_against_brute(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = suffix_levels.op4_suffix_levels(spark, SF).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 400)


def test_empty_table(stored):
    docs = stored([(1, "a")])
    assert remove_repeats(docs.where(F.lit(False))).count() == 0
    assert remove_repeats(docs).first().n_removed == 0
