from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geotext.llm import chunk_recipes, common
from geotext.llm.chunk_recipes import boundaries, chunks_of, drop_copies, find_copies, normalise


def brute(rows):
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i or 0, at, i))
    out = {}
    for t, members in groups.items():
        first = min(members)
        for m in members:
            out[m[2]] = (m[3], first[3], len(members), m == first, hashlib.sha256(t.encode()).hexdigest())
    return sorted(map(str, out.values()))


def inputs():
    maker = random.Random(2)
    long = " ".join(maker.choice(["alpha", "beta", "gamma", "délta", "eps\tilon"]) for _ in range(9000))
    texts = ["", None, " ", "\n\t", "a b", "a  b", "a b", " a b", "a b ", "a\x0bb", long, long + "x", long.replace("eps\t", "eps \n "), "z" * 70_000, "z" * 70_001]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "hot") for i in range(60)] + [(99, "hot"), (99, "hot"), (None, "hot"), (None, None)]
    return rows


@pytest.fixture
def stored(spark, tmp_path):
    def store(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("h", F.lit(1))
        docs.coalesce(2).write.parquet(str(tmp_path / "docs"))
        return spark.read.parquet(str(tmp_path / "docs"))

    return store


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute(stored, weak):
    name = (lambda c: len(c) % 3) if weak else chunk_recipes.chunk_hash  # weak: many contents share a name
    rows = inputs()
    docs = stored(rows)
    got = find_copies(docs, name=name).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == brute(rows)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(r.kept for r in got)


def test_empty_table(stored):
    docs = stored([(1, "a")]).where(F.lit(False))
    assert find_copies(docs).count() == 0 and drop_copies(docs).count() == 0


def test_chunks_are_whole_and_local():
    maker = random.Random(9)
    data = bytes(maker.randrange(97, 123) for _ in range(60_000))
    ends = boundaries(data)
    assert b"".join(chunks_of(data)) == data and ends[-1] == len(data)
    assert max(map(len, chunks_of(data))) <= chunk_recipes.LARGEST
    moved = chunks_of(b"0123456789" * 7 + data)
    assert len(set(moved) & set(chunks_of(data))) > 0.8 * len(moved)


def test_normalise():
    for t in ("", " ", " a", "a ", "\x0b\x0ca\x1cb", "a\x85　b", "  a \n b\t"):
        assert normalise(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_long_texts_reach_workers_in_short_batches(spark, stored, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 50_000)

    def recipe_of(name):  # tells how many texts came at once
        @F.pandas_udf("struct<recipe: array<long>, text_sha256: string>")
        def make(texts):
            import pandas as pd

            return pd.DataFrame({"recipe": [[k] for k in range(len(texts))], "text_sha256": [str(len(texts))] * len(texts)})

        return make

    monkeypatch.setattr(chunk_recipes, "recipe_of", recipe_of)
    docs = stored([(i, f"{i} " + "x" * 1000) for i in range(600)])
    assert max(int(r.text_sha256) for r in find_copies(docs).collect()) < 100
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "50000"
