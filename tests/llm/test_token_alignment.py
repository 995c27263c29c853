from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geotext.llm import token_alignment
from geotext.llm.common import table
from geotext.llm.token_alignment import Aligner, align_documents, op11_token_alignment
from geotext.operators import skew

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in (token_alignment.BYTE_TOKENIZER, token_alignment.PIECE_TOKENIZER))


class Brute:
    """Whole texts through the libraries, tokens aligned one by one."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        with open(A, encoding="utf-8") as file:
            self.vocab = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printing]
        self.byte = {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        of_a = [bytes(self.byte[c] for c in self.vocab[i]) for i in a]
        of_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        if b"".join(of_a) != want or b"".join(of_b) != want:
            return []
        found, left, right, at_a, at_b = [], [], [], 0, 0
        of_a, of_b, a, b = of_a[::-1], of_b[::-1], a[::-1], b[::-1]
        while a or b:
            if at_a <= at_b:
                left.append(a.pop())
                at_a += len(of_a.pop())
            else:
                right.append(b.pop())
                at_b += len(of_b.pop())
            if at_a == at_b:
                found.append((left, right))
                left, right = [], []
        return found

    def rows(self, docs):
        every = [(i, self.groups(t)) for i, t in docs]
        count = Counter((g[0][-1], g[1][-1]) for _, groups in every for g in groups)
        best = defaultdict(int)
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        for i, groups in every:
            links = [(g[0][-1], g[1][-1]) for g in groups]
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
            yield (
                i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), digest,
            )


@pytest.fixture(scope="module")
def brute():
    return Brute()


ODD = [
    None, "", " ", "\n", "  ", " \n \n", "a  b\n\n  c \n", "\ta\t\tb", "x \t y\r\n", "don't I'LL we've 's", "<|endoftext|>", "</s><s> <0x41> <unk>",
    "▁a", "a ▁ b", "　wide　 　x", "\xa0 nb\xa0sp", "é ́x ﬁ ½", "日本語 テキスト\n 語", "\U0001f642\U0001f469‍\U0001f469",
    "\x00\x01\x1c \x1d\n\x85", "a" * 3000, "ab" * 2000, "!?" * 900, "12345 678", " " * 700 + "x", "\n" * 300, "line one\nline two\n\nline", "MiXeD CaSe  Words,and;marks",
]


def noise():
    maker = random.Random(3)
    letters = [32, 32, 10, 39, 97, 98, 233, 0x3B1, 0x4E2D, 0x1F600, 49, 46, 9, 0x2581, 0xA0]
    return ["".join(chr(maker.choice(letters[: maker.choice([9, 13, 15])])) for _ in range(maker.randrange(60))) for _ in range(300)]


def test_segments_give_the_tokens_of_the_whole():
    aligner = Aligner(A, B)
    assert aligner.by_segment and aligner.ranks is not None
    documents = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for text in [t for t in ODD + noise() + documents if t]:
        assert aligner.ids(text) == aligner.whole(" " + text), repr(text)


def test_small_memory_of_segments(monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_SEGMENTS", 2)
    aligner = Aligner(A, B)
    text = "the quick brown fox jumps over the lazy dog and the quick cat the the fox"
    assert aligner.ids(text) == aligner.whole(" " + text)
    assert len(aligner.segments) <= 2 and len(aligner.segments.older) <= 2


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_equals_brute_force(spark, brute, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(token_alignment, "SLICE_PAIRS", 50)
    monkeypatch.setattr(token_alignment, "SLICE_TEXTS", 7)
    texts = ODD + noise()[:120]
    docs = [(i, t) for i, t in enumerate(texts)] + [(500 + i, "one text with many copies") for i in range(40)]
    docs += [(None, "a b"), (None, None), (7, "a b"), (7, "a b")]
    rows = [(i, t, "x", 1) for i, t in docs]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string, copies int").repartition(4)
    got = align_documents(table)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute.rows(docs)))


def test_pairs_stay_within_the_bound(spark):
    aligner = Aligner(A, B)
    docs = table(spark, SF, "documents").where("text <> ''").select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", F.lit(1).cast("long").alias("copies"))
    counts = token_alignment.pair_counts(token_alignment.align_texts(docs), aligner.number).collect()
    assert 0 < len(counts) < aligner.pair_bound() < 3_000_000
    for r in counts:
        a, b = aligner.bytes_a[r.pair // len(aligner.bytes_b)], aligner.bytes_b[r.pair % len(aligner.bytes_b)]
        assert a.endswith(b) or b.endswith(a)


def test_query_equals_brute_force(spark, brute):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = op11_token_alignment(spark, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.rows(docs)))


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").where(F.lit(False))
    assert align_documents(docs).count() == 0
