from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geotext.llm import two_fit
from geotext.llm.common import table
from geotext.llm.two_fit import Ids, fill, make_plan, pack_documents, sequences

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    "", " ", "It's DON'T 'S we'LL", "ÀÉÎ ſŉ ª² ½ 12a b_c --'s!!", "İstanbul ΑΣ", "é ẞ", "<|endoftext|> a <|startoftext|>",
    "日本語 テ🙂", "x" * 4000, "a\x1c\x1db\x85c\xa0d　e", "\x00\x07", "²³¹ 9٣", "ǅ Ⱥ ȿ ɐ", "''ss 're're ''ve",
]


def test_ids_equal_the_library(library):
    ids, maker = Ids(PATH), random.Random(1)
    assert ids.by_word
    noise = ["".join(maker.choice("aB' ss!é1²\n_-ÀßŸſªºx") for _ in range(60)) for _ in range(400)]
    for t in ODD + noise:
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_few_kept_words(library, monkeypatch):
    monkeypatch.setattr(two_fit, "KEPT_WORDS", 3)
    ids = Ids(PATH)
    for t in ("one two three four five", "six one two", "x" * 100 + " one"):
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def check_placed(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [4096, 50])
def test_documents(spark, library, capacity):
    maker = random.Random(2)
    texts = [*ODD, None, "hot"] + ["hot"] * 40 + [" ".join(maker.choice("abcdé") for _ in range(maker.randrange(9000))) for _ in range(12)]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(None, "hot", None), (1, " ", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    placed = pack_documents(docs, with_ids=True, capacity=capacity)
    got = placed.collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(want_ids(library, t), "<u4")
        for p in range(0, len(ids), capacity):
            part = ids[p : p + capacity]
            want[i, p // capacity, p, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_placed(got, capacity)
    assert n <= 1.1 * sum(r.length for r in got) / capacity + 1
    whole = sequences(placed).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r.length for r in got)
    assert len(whole) == n


def test_two_take_the_place_of_the_shortest():
    left = np.zeros(101, dtype=np.int64)
    left[[60, 30, 22, 17]] = 1
    assert fill(left, 100) == [60, 22, 17]  # greedy: 60 and 30, ten short
    left[17] = 0
    assert fill(left, 100) == [60, 30]


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    maker = random.Random(seed)
    capacity = maker.choice([1, 7, 64, 300])
    count = np.array([0] + [maker.choice([0, 0, 1, 2, 50, 3000]) for _ in range(capacity)])
    plan = make_plan(count, capacity)
    full = defaultdict(list)
    for n in np.flatnonzero(count):
        ranks = np.arange(count[n])
        for s, o in zip(*plan.place(np.full(count[n], n), ranks), strict=True):
            full[s].append((int(o), int(n)))
    for parts in full.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(full) == plan.sequences


def test_query_fills_its_sequences(spark):
    got = two_fit.op3_two_fit(spark, SF).collect()
    n = check_placed(got, 4096)
    total = sum(r.length for r in got)
    assert n == -(-total // 4096)
    assert {r.doc_id for r in got} == {r.doc_id for r in table(spark, SF, "documents", "doc_id").collect()}


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(False))
    assert pack_documents(docs).count() == 0
