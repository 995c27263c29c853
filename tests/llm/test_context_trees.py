from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotext.llm import context_trees
from geotext.llm.common import table
from geotext.llm.context_trees import ORDER, fit, predict_language

SF = "/root/testdata/sf0.01"


def brute_bits(texts, text, share):
    """Code length by walking from the longest kept context to shorter ones, byte by byte."""
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        data = b"   " + t.encode()
        for i in range(3, len(data)):
            for k in range(ORDER + 1):
                counts[k][data[i - k : i], data[i]] += 1
    total = sum(counts[0].values())
    size = [Counter() for _ in counts]
    for k, c in enumerate(counts):
        for (context, _), n in c.items():
            size[k][context] += n
    data, bits = b"   " + text.encode(), 0.0
    for i in range(3, len(data)):
        p, excluded = 1.0, set()
        for k in range(ORDER, -1, -1):
            context = data[i - k : i]
            if k > 1 and size[k][context] < total * share:
                continue
            n = {b: counts[k][context, b] for b in range(256) if counts[k][context, b] and b not in excluded}
            if not n:
                continue
            if data[i] in n:
                p *= n[data[i]] / (sum(n.values()) + len(n))
                break
            p *= len(n) / (sum(n.values()) + len(n))
            excluded |= set(n)
        else:
            p /= 256 - len(excluded)
        bits -= math.log2(p)
    return bits


def sample(maker, letters, n=60):
    return "".join(maker.choice(letters) for _ in range(n))


def test_code_lengths_against_brute(spark):
    maker = random.Random(1)
    texts = {"aa": [sample(maker, "abc ab é.") for _ in range(12)], "bb": [sample(maker, "xyzab zy ñ") for _ in range(9)]}
    rows = [(t, lang) for lang, some in texts.items() for t in some]
    trees = fit(spark.createDataFrame(rows, "text string, lang string"), share=0.02)
    assert trees.langs == ["aa", "bb"]
    for t in ["abc", "zyx é", "Q", "ab ab ab", sample(maker, "abcxyz ñé!Ω")]:
        want = [brute_bits(texts[lang], t, 0.02) for lang in trees.langs]
        assert trees.bits(t.encode()) == pytest.approx(want, rel=1e-5)


def test_probabilities_sum_to_one():
    maker = np.random.default_rng(4)
    seen = [maker.poisson(0.02 * 4**k, (50, 256)) for k in range(3)]
    assert context_trees.probabilities(seen).sum(axis=1) == pytest.approx(np.ones(50))


def test_edges(spark):
    maker = random.Random(2)
    rows = [(i, sample(maker, "abc ab"), "aa", 1) for i in range(50)] + [(i, sample(maker, "xyz zy"), "bb", 1) for i in range(50)]
    odd = [(90, None, "aa", 1), (91, "", "aa", 1), (92, "12 3_ !?", None, 1), (93, "x" * 3_000_000, None, 1), (None, "abcab", None, 1), (93, "zzz", None, 1), (93, "zzz", None, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    got = predict_language(docs).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert 0.5 <= r.score <= 1
            assert r.lang_pred == ("aa" if "a" in r.text or "b" in r.text or "c" in r.text else "bb")
    nothing = predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert predict_language(docs.where(F.lit(False))).count() == 0


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    got = context_trees.op5_context_trees(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held)
