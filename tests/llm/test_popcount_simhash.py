from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geotext.llm import popcount_simhash
from geotext.llm.common import table
from geotext.llm.popcount_simhash import drop_near_copies, fingerprint, links_of, near_copies

SF = "/root/testdata/sf0.01"


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limit=4):
    """Lowest fingerprint reachable from each distinct one."""
    distinct = np.array(sorted(set(prints)), dtype=np.uint64)
    root = {}
    for start in range(distinct.size):
        if start in root:
            continue
        root[start], todo = start, [start]
        while todo:
            near = np.flatnonzero(np.bitwise_count(distinct ^ distinct[todo.pop()]) <= limit)
            for n in near.tolist():
                if n not in root:
                    root[n] = start
                    todo.append(n)
    return {int(distinct[k]): int(distinct[v]) for k, v in root.items()}


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(prints)
    ids = defaultdict(list)
    for (i, _), p in zip(rows, prints, strict=True):
        ids[root[p]].append(i)
    lowest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(i, f"{p:016x}", lowest[root[p]]) for (i, _), p in zip(rows, prints, strict=True)]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b\x0bC", "a b c d", "É é\x85x  y z w", "x " * 70_000, "The cat\tsat on THE mat"])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == brute_print(text)


def near(maker, start, n, flips):
    """A walk of fingerprints, each a few bits off an earlier one."""
    out = [start]
    for _ in range(n - 1):
        x = maker.choice(out)
        for _ in range(maker.randrange(flips + 1)):
            x ^= 1 << maker.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("point_rows", [20_000, 10])
@pytest.mark.parametrize("limit", [4, 3])
def test_links_chain_like_all_links(spark, point_rows, limit):
    maker = random.Random(7)
    prints = [maker.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1, 1 << 63]
    for n, flips in [(2, 4), (5, 5), (60, 3), (60, 5), (40, 7)]:
        prints += near(maker, maker.getrandbits(64), n, flips)
    distinct = sorted(set(prints))
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in distinct]
    got = links_of(spark.createDataFrame(rows, "fp long"), limit, point_rows).collect()
    assert all((r.a ^ r.b).bit_count() <= limit if (r.a ^ r.b) >= 0 else ((r.a ^ r.b) % (1 << 64)).bit_count() <= limit for r in got)
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in got:
        a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
        parent[max(a, b)] = min(a, b)
    assert {p: find(p) for p in distinct} == brute_components(distinct, limit)


def test_edges(spark, tmp_path):
    maker = random.Random(3)
    base = [maker.choice("one two three four five six seven".split()) for _ in range(400)]
    rows = [(50, None), (40, ""), (41, " "), (None, "lonely words here now yes"), (7, " ".join(base)), (7, " ".join(base)), (9, " ".join(base))]
    for i in range(30):
        words = list(base)
        words[maker.randrange(400)] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, "long " * 60_000), (5, "a b c d e f")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    got = near_copies(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({r.component_id for r in got}) == sum(r.kept for r in got)
    assert near_copies(docs.where(F.lit(False))).count() == 0


def test_query_against_brute(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = popcount_simhash.op1_popcount_simhash(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
