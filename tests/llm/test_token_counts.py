from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geotext.llm import token_counts
from geotext.llm.common import table
from geotext.llm.token_counts import PairRanks, count_tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = [
    "", " ", "\n\n  \t x", "don't I'LL we've 's", "<|endoftext|>", "a<|endoftext|><|endoftext|> b ", "<|endoftext",
    "éàü ñ 日本語 テキスト", "a" * 5000, "ab" * 3000, "!?" * 2000, "1234567890" * 300, "  " * 900, "\x00\x01\x7f\x85\xa0 x",
    "é ﬁ ½ Ⅷ ٣ 🙂👩‍👩‍👧", "tab\there　wide line", " x​z", "\x1c\x1d\x1e\x1f a",
]


def test_counts_equal_the_library(spark, library):
    maker = random.Random(5)
    noise = ["".join(chr(maker.choice([32, 39, 97, 233, 0x3B1, 0x4E2D, 0x1F600, 10, 49, 46])) for _ in range(maker.randrange(90))) for _ in range(200)]
    texts = ODD + noise
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(0, "", 7), (None, None, None)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"))
    for r in got.collect():
        want = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 512), r.text


def test_small_memory_of_pieces(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 3)
    ranks = PairRanks(PATH)
    text = "the quick brown fox jumps over the lazy dog and the quick cat"
    assert ranks.count(text) == len(library.encode(text).ids)
    assert len(ranks.kept) <= 3


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = token_counts.op10_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(False))
    assert count_tokens(docs).count() == 0
