from __future__ import annotations

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotext.llm import size_aware_join
from geotext.llm.common import table
from geotext.llm.size_aware_join import has_partners, jaccard_components, keys_of, least_overlap, op13_size_aware_join, parities_of, prefix_length, shingle_set
from geotext.operators import skew

SF = "/root/testdata/sf0.001"


def brute_set(text, size=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, size=5, percent=80):
    """All pairs, through an index of shingles, and the lowest id reachable."""
    sets = [brute_set(t, size) for _, t in docs]
    held = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            held[x].append(k)
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for other in held[x]:
                shared[other] += other < k
        for other, n in shared.items():
            if n and 100 * n >= percent * (len(s) + len(sets[other]) - n):
                root[find(k)] = find(other)
    lowest = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        lowest[find(k)].append(i)
    return [(i, len(s), min((x for x in lowest[find(k)] if x is not None), default=None)) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def edited(maker, words, changes):
    words = list(words)
    for _ in range(changes):
        at = maker.randrange(len(words))
        words[at : at + maker.randrange(2)] = maker.choice([[], [f"e{maker.randrange(999)}"]])
    return words


def corpus(seed):
    """Chains of edits, shared passages, short texts, copies but for case and space, and odd ones."""
    maker = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = maker.choices(vocabulary, k=40)
    texts = []
    for _ in range(12):
        words = maker.choices(vocabulary, k=maker.choice([6, 9, 14, 30, 60, 150, 400]))
        for _ in range(maker.randrange(1, 14)):
            texts.append(" ".join(words))
            words = edited(maker, words, maker.choice([1, 1, 2, max(1, len(words) // 40)])) or ["x"]
    texts += [" ".join(passage + maker.choices(vocabulary, k=maker.randrange(0, 30))) for _ in range(40)]
    texts += [" ".join(passage[: k % 9]) for k in range(25)]
    texts += [t.upper().replace(" ", "\n\t ") for t in maker.choices(texts, k=15)] + maker.choices(texts, k=10)
    texts += [None, None, "", " \n", "é É", "É é", "one", "ONE", "x " * 3000, "x " * 9, "a\x85b c d e f g"]
    maker.shuffle(texts)
    return list(enumerate(texts, 100))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b\x0bC", "a b c d e", "É é\x85x  y z w q", "x " * 7000, "The cat\tsat on THE mat the CAT sat on the mat"])
def test_set_sizes(text):
    assert shingle_set(text).size == len(brute_set(text))


@pytest.mark.parametrize("percent", [50, 73, 80, 99])
def test_prefixes_hold_what_is_shared(percent):
    maker = random.Random(percent)
    for _ in range(300):
        a = set(maker.sample(range(1000), maker.randrange(1, 40)))
        b = (a - set(maker.sample(sorted(a), maker.randrange(0, 1 + len(a) // 4)))) | set(maker.sample(range(1000, 1100), maker.randrange(0, 1 + len(a) // 4)))
        if not b or 100 * len(a & b) < percent * len(a | b) or a == b:
            continue
        assert has_partners(len(a), percent) and has_partners(len(b), percent)
        order = sorted(a | b, key=lambda x: x * 7919 % 1009)
        for small in (0, 10, 25, 1000):
            met = []
            for s in (a, b):
                first = np.array([x for x in order if x in s][: prefix_length(len(s), 2, percent)], np.uint64)
                keys, left = keys_of(first, len(s), small, percent)
                assert keys.size == left.size and left.max() <= len(s)
                met.append(set(keys.tolist()))
            assert met[0] & met[1], (sorted(a), sorted(b), small)
    assert least_overlap(5, 80) == 4 and not has_partners(3, 80) and has_partners(4, 80)


def test_parities_differ_in_no_more_places_than_sets():
    maker = np.random.default_rng(4)
    for n in (1, 7, 90, 2000):
        a = maker.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[n // 3 :], maker.integers(0, 1 << 63, n // 4).astype(np.uint64)]))
        differ = sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(parities_of(a), parities_of(b), strict=True))
        assert differ <= np.setxor1d(a, b).size


@pytest.mark.parametrize("seed,small,list_rows", [(1, None, 4000), (2, 0, 3), (3, 20, 2), (4, 10**6, 5), (5, None, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, small, list_rows):
    monkeypatch.setattr(size_aware_join, "LIST_ROWS", list_rows)
    monkeypatch.setattr(size_aware_join, "SLOT_BITS", 8 if seed % 2 else 22)
    monkeypatch.setattr(size_aware_join, "FILTER_BITS", 11 if seed == 3 else 27)
    monkeypatch.setattr(size_aware_join, "KEPT_DIGESTS", 3 if seed == 2 else 500_000)
    monkeypatch.setattr(size_aware_join, "SLICE_ROWS", 50)
    monkeypatch.setattr(size_aware_join, "LONG_LIST", 64 if seed == 1 else 2)
    monkeypatch.setattr(skew, "HOT_ROWS", 12 if seed in (2, 5) else 1_000_000)
    docs = corpus(seed) + [(None, "one"), (100, "other words that stand under an id of its own"), (None, "no id at all for this one")]
    wide = [(i, t, 5, "x", b"y") for i, t in docs]
    frame = spark.createDataFrame(wide, "doc_id long, text string, n int, name string, digest binary").repartition(5)
    got = jaccard_components(frame, small=small)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows(got) == sorted(map(repr, brute(docs)))


@pytest.mark.parametrize("seed", [7])
def test_drawn_rounds_equal_brute_force(spark, monkeypatch, seed):
    for name, value in {"CROWDED": 3, "DRAWN": 2, "MORE_DRAWN": 50, "LONG_LIST": 2, "LIST_ROWS": 5}.items():
        monkeypatch.setattr(size_aware_join, name, value)
    docs = corpus(seed)[:60] + near_copies(60, 500)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(jaccard_components(frame, small=0)) == sorted(map(repr, brute(docs)))


def near_copies(many, first):
    """Of one text, with a word or more changed in most: some pairs are similar enough, more are not quite."""
    maker = random.Random(many)
    words = [f"n{k}" for k in range(150)]
    texts = []
    for _ in range(many):
        own = list(words)
        for at in maker.sample(range(150), maker.choice([1, 2, 2, 3, 3, 3])):
            own[at] = f"c{maker.randrange(10**6)}"
        texts.append(" ".join(own))
    return list(enumerate(texts, first))


def test_candidates_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    pairs = []
    verified = size_aware_join.verified

    def counted(some, *rest):
        pairs.append(some.count())
        return verified(some, *rest)

    monkeypatch.setattr(size_aware_join, "verified", counted)
    made = []
    for many in (400, 1200):
        docs = near_copies(many, 1)
        pairs.clear()
        got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {(r.n_shingles, r.component_id) for r in got.collect()} == {(146, 1)}
        made.append(sum(pairs))
    assert made[1] < 6 * made[0]


def test_intermediate_tables_and_sets_of_others_go(spark, monkeypatch):
    for name, value in {"CROWDED": 3, "DRAWN": 2, "MORE_DRAWN": 50, "LONG_LIST": 2}.items():
        monkeypatch.setattr(size_aware_join, name, value)
    made, met = [], []
    stored, verified = size_aware_join.stored, size_aware_join.verified

    def noted(df, *rest):
        made.append(stored(df, *rest))
        return made[-1]

    def counted(pairs, sets, percent):
        met.append((sets.count(), size_aware_join._names(pairs).count()))
        return verified(pairs, sets, percent)

    monkeypatch.setattr(size_aware_join, "stored", noted)
    monkeypatch.setattr(size_aware_join, "verified", counted)
    docs = corpus(7)[:60] + near_copies(60, 500)
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), small=0)
    assert rows(got) == sorted(map(repr, brute(docs)))
    folders = [f.inputFiles()[0].removeprefix("file:").replace("//", "/").rsplit("/", 1)[0] for f in made if f.inputFiles()]
    assert sum(map(os.path.isdir, folders)) < 0.7 * len(folders), (sum(map(os.path.isdir, folders)), len(folders))
    # The sets of all that were candidates before are not moved again for a few pairs.
    assert len(met) > 1 and all(sets <= names + 1 for sets, names in met[1:]), met


def test_other_shingles_and_similarity(spark):
    docs = corpus(9)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jaccard_components(frame, size=2, percent=60)) == sorted(map(repr, brute(docs, 2, 60)))


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert rows(op13_size_aware_join(spark, SF)) == sorted(map(repr, brute(docs)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert jaccard_components(docs.where(F.lit(False))).count() == 0
    assert rows(jaccard_components(docs)) == ["(1, 0, 1)", "(2, 0, 2)"]
