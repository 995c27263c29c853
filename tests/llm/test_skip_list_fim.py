from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotext.llm.skip_list_fim import SkipList, fill_in_middle, line_widths, restored, tower_heights


def brute(doc_id, text, cut=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return doc_id, len(lines), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17, 1000])
def test_every_rank(n):
    maker = random.Random(n)
    widths = [maker.randrange(1, 90) for _ in range(n)]
    units = SkipList(widths)
    assert [units.points_before(k) for k in range(n + 1)] == [sum(widths[:k]) for k in range(n + 1)]
    for units_passed, points in units.lanes:
        assert units_passed.sum() <= n and points.sum() <= sum(widths)
    with pytest.raises(IndexError):
        units.points_before(n + 1)


def test_lanes_thin_out():
    heights = tower_heights(100_000)
    shares = [float((heights >= k).mean()) for k in range(1, 4)]
    assert np.allclose(shares, [1 / 4, 1 / 16, 1 / 64], rtol=0.1)
    assert len(SkipList([1] * 100_000).lanes) >= 6


def test_lines():
    for text in ("", "a", "a\n", "\n", "\n\nb", "é\n\U0001f600x\r\ny", "a\x0bb\x85c d\n"):
        assert line_widths(text) == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


TEXTS = [
    None, "", "\n", "one line", "a\nb\nc", "a\n\n\nb\n", "has <P> inside\nx", "x\n<M>", "<S", "P>\n<\nS>\n<M\n>", "<\n<S\n<M\n", "\r\n \x0b\n",
    "é\n\U0001f600\U0001f469‍\U0001f469\n日本\n語", "line\n" * 5000, "w" * 200_000 + "\nend",
]


@pytest.mark.parametrize("cut,spm", [(100, 50), (40, 0), (70, 100), (0, 50)])
def test_equals_brute_force(spark, cut, spm):
    rows = [(i, t, "clash", 1) for i in range(4) for t in TEXTS] + [(None, "a\nb\n", "n", 2)] * 2
    rows += [(10**12 + i, "x\ny\nz\n" * (i % 5), None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, cuts int").repartition(5)
    made = fill_in_middle(docs, cut_percent=cut, suffix_first_percent=spm)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = [(*brute(i, t, cut, spm), t or "") for i, t, *_ in rows]
    key = repr
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(False))
    assert fill_in_middle(docs).count() == 0
