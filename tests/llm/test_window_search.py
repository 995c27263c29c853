from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from geotext.llm import window_search
from geotext.llm.window_search import drop_contaminated, find_windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        t = words(item_text)
        n = min(window, len(t))
        wanted = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if t else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def tables(seed):
    maker = random.Random(seed)
    say = lambda n: " ".join(maker.choice(["a", "b", "C3", "É", "d-e", "the"]) for _ in range(n))
    items = [(i, say(maker.randrange(0, 40))) for i in range(15)]
    items += [(15, items[3][1]), (15, "the"), (16, None), (17, ""), (None, say(12)), (18, "!!"), (19, "b b b b b b b b b b b b")]
    docs = [(i, say(maker.randrange(0, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "b " * 5000), (93, "unlike words only")]
    docs += [(200 + at, f"{say(9)} {t}! {say(9)}") for at, (_, t) in enumerate(items)]
    return docs + docs[-2:], items


@pytest.mark.parametrize("block_words", [300_000, 25])
def test_against_brute(spark, block_words):
    docs, items = tables(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("_x", F.lit("k"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_windows(frame, bench, block_words=block_words).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(r.text, items)
        assert (r.n_words, r.n_hit, r["items"]) == want, r
        assert r.contaminated == (want[1] > 0)
        covered = [k for s in r.spans for k in range(s.start, s.end)]
        assert len(covered) == len(set(covered)) == r.n_hit
    left = drop_contaminated(frame, bench, block_words=block_words)
    assert left.columns == frame.columns
    assert left.count() == sum(not r.contaminated for r in got)


def test_no_short_items_skips_far(spark):
    bench = [(1, " ".join(f"w{i}" for i in range(30)))]
    docs = [(1, "x " * 50 + " ".join(f"W{i}" for i in range(12, 23)) + " y"), (2, " ".join(f"w{i}" for i in range(9)))]
    got = find_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert [(r.doc_id, r.n_hit) for r in got.collect()] == [(1, 11), (2, 0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = find_windows(docs, bench.where(F.lit(False))).first()
    assert (got.n_words, got.n_hit, got["items"]) == (2, 0, [])
    assert find_windows(docs.where(F.lit(False)), bench).count() == 0


def test_blocks_store_no_text_and_clashing_columns_stay(spark, tmp_path, monkeypatch):
    docs, items = tables(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    mine = {"_found": "f", "_tag": "t", "row_tag": "r", "starts": "s", "each": "e"}
    frame = frame.withColumns({c: F.concat(F.lit(v), F.col("doc_id").cast("string")) for c, v in mine.items()})
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    kept = []
    whole = window_search.stored
    monkeypatch.setattr(window_search, "stored", lambda df: kept.append(df.columns) or whole(df))
    got = find_windows(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=25).collect()
    assert len(kept) >= 5 and all(c == ["_tag", "starts", "ends", "items"] for c in kept)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, items)
        assert all(r[c] == f"{v}{r.doc_id}" for c, v in mine.items())
