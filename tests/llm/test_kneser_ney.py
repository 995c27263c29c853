from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geotext.llm import kneser_ney
from geotext.llm.common import Buckets, table
from geotext.llm.kneser_ney import count_all, discounts, drop_toxic, score_toxicity
from geotext.llm.labelled import fit_logistic, pool_adjacent

SF = "/root/testdata/sf0.01"


def talk(maker, n, bad=0):
    words = [maker.choice("the a cat dog runs over small hill blue red and or sits".split()) for _ in range(n)]
    for _ in range(bad):
        words[maker.randrange(n)] = maker.choice(["scum", "moron"])
    return " ".join(words)


@pytest.fixture(scope="module")
def taught(spark):
    maker = random.Random(1)
    rows = [(i, talk(maker, maker.randrange(5, 60), bad=i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(3).cache()


def test_edges(spark, taught):
    maker = random.Random(8)
    rows = [(1, None, 1), (2, "", 2), (None, "scum", 3), (4, "the cat " * 40_000, 4), (4, talk(maker, 30, 1), 5), (4, talk(maker, 30, 1), 5), (5, "ünï ¿? !!", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").unionByName(taught.select("doc_id", "text", F.lit(0).alias("score")))
    labels = taught.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (7, None), (8, 1), (8, 0)], "doc_id long, toxic int"))
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    odd = {r.text: r.predicted for r in got[:7]}
    assert odd[None] == odd[""] == odd["the cat " * 40_000] == 0 and odd["scum"] == 1
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(1 - r.predicted for r in got)


def test_held_out_accuracy(spark):
    toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    got = kneser_ney.op2_kneser_ney(spark, SF).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)


def test_held_out_precision_and_recall(spark):
    """On the largest table. 23 of 144 held-out toxic rows hold none of the insults, so recall by them is 0.84 at best; 0.722 was measured."""
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    got = kneser_ney.op2_kneser_ney(spark, folder).select("doc_id", "held_out", "predicted").collect()
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    hits = sum(p and y for p, y in held)
    precision, recall = hits / sum(p for p, _ in held), hits / sum(y for _, y in held)
    assert precision >= 0.95 and recall >= 0.7


def test_columns_of_any_name_stay(spark, taught):
    named = taught.select("doc_id", "text", *[F.lit(7).alias(k) for k in ("_judged", "_text", "row_tag", "_learn", "_score", "c0")])
    got = score_toxicity(named, taught.select("doc_id", "toxic"))
    assert got.columns == [*named.columns, "log_ordinary", "log_toxic", "score", "predicted"]
    assert got.where("_judged + _text + row_tag + _learn + _score + c0 = 42").count() == 600
    left = drop_toxic(named, taught.select("doc_id", "toxic"))
    assert left.columns == named.columns and left.where("_text = 7").count() == got.where("predicted = 0").count()


def test_fits():
    assert pool_adjacent(np.array([1.0, 3, 2, 2, 5]), np.ones(5)).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])
    x = np.array([[0.0], [1], [2], [3]])
    w, b = fit_logistic(x, np.array([0.0, 0, 1, 1]))
    assert w[0] > 0 and b < 0


def brute_log_likelihoods(taught):
    """Of each class, a function that gives a text's mean log probability, from ``(text, label)``."""
    count = [Counter(), Counter()]
    for text, label in taught:
        words = ["", *text.split()]
        count[label].update(zip(words, words[1:]))
    shared = set(count[0]) | set(count[1])

    def lower(pairs):
        types = Counter(b for _, b in pairs)
        d = discounts(np.array(list(types.values())))
        lost = sum(min(d[min(n, 3)], n) for n in types.values())
        return lambda w, back: (types[w] - min(d[min(types[w], 3)], types[w]) + lost * back) / len(pairs)

    base, both = 1 / (len({b for _, b in shared}) + 1), lower(shared)

    def of(c):
        once, twice = (sum(n == k for n in count[c].values()) for k in (1, 2))
        cut = once / (once + 2 * twice) if once else 0.5
        own, total, kinds = lower(count[c]), Counter(), Counter(a for a, _ in count[c])
        for (a, _), n in count[c].items():
            total[a] += n

        def log_of(a, b):
            back = own(b, both(b, base))
            return math.log((max(count[c][a, b] - cut, 0) + cut * kinds[a] * back) / total[a] if total[a] else back)

        def mean(text):
            words = ["", *text.split()]
            return sum(map(log_of, words, words[1:])) / max(len(words) - 1, 1)

        return mean

    return of(0), of(1)


def check_likelihoods(spark, vocabulary, known_keys, monkeypatch):
    monkeypatch.setattr(kneser_ney, "KNOWN_KEYS", known_keys, raising=False)
    maker = random.Random(4)
    rows = [(i, " ".join(maker.choices(vocabulary, k=60)), int(i % 4 == 0)) for i in range(400)]
    rows += [(i, " ".join(maker.choices([*vocabulary, "never", "seen"], k=20)), None) for i in range(400, 440)]
    rows += [(440, rows[0][1], None), (441, "", None), (442, rows[401][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    left_out = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(8)) == 0
    taught = docs.where(~left_out & F.col("toxic").isNotNull()).select("text", "toxic").collect()
    ordinary, toxic = brute_log_likelihoods(taught)
    got = score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.log_ordinary == pytest.approx(ordinary(r.text), abs=1e-4), r.doc_id
        assert r.log_toxic == pytest.approx(toxic(r.text), abs=1e-4), r.doc_id


@pytest.mark.parametrize("known_keys", [0, 300])
def test_every_counted_pair_keeps_its_estimate(spark, known_keys, monkeypatch):
    """More than 10,000 different pairs, of which dozens would share one of 1,048,573 slots."""
    check_likelihoods(spark, [f"w{i}" for i in range(150)], known_keys, monkeypatch)


def test_words_that_share_22_bits_are_told_apart(spark, monkeypatch):
    words = [f"w{i}" for i in range(6000)]
    assert len({xxhash.xxh3_64_intdigest(w.encode()) >> 42 for w in words}) < len(words)
    check_likelihoods(spark, words, 1000, monkeypatch)


@pytest.mark.parametrize("kind", ["none", "one"])
def test_whole_tables_without_both_labels(spark, taught, kind):
    labels = taught.select("doc_id", F.lit(1).alias("toxic")).where(F.lit(kind == "one"))
    got = score_toxicity(taught.drop("toxic"), labels).select("score").distinct().collect()
    assert len(got) == 1 and got[0].score == pytest.approx(float(kind == "one"), abs=1e-3)
    assert score_toxicity(taught.where(F.lit(False)), labels).count() == 0


def test_only_rows_that_calibrate_are_left_out(spark):
    """Each text has a word of its own: it is likelier where its row is counted."""
    rows = [(i, f"own{i} " * 6, i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = score_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"), calibration_share=2, calibration_rows=10)
    unlike = sum(abs(r.log_toxic - r.log_ordinary) < 0.5 for r in got.collect())
    assert 0 < unlike <= 20


def test_spent_shuffles_go(spark, taught):
    """Else those of all steps lie on the disks together."""
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for folder in folders for f in folder.rglob("shuffle_*.data")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = files(), spark.conf.get(setting)
    left = drop_toxic(taught.select("doc_id", "text"), taught.select("doc_id", "toxic"))
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(setting) == set_to and not [t for t in spark.catalog.listTables() if t.name.startswith("geotext_")]
    assert 0 < left.count() < 600


def test_a_table_in_buckets_stays_where_it_is(spark):
    held = Buckets(spark, "key", 4)
    for low in (0, 50):
        held.add(spark.range(low, low + 50).select(F.xxhash64("id").alias("key"), F.col("id").alias("x")))
    asked = spark.range(200).select(F.xxhash64(F.col("id") % 120).alias("key"), F.col("id").alias("n"))
    met = asked.join(held.rows.hint("shuffle_hash"), "key", "left")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.n, r.x) for r in met.collect() if r.x is not None) == [(n, n % 120) for n in range(200) if n % 120 < 100]
    assert met.count() == 200
    held.drop()
    assert not spark.catalog.tableExists(held.name)


def test_passes_share_the_pairs(spark):
    texts = spark.createDataFrame([("a b c a b ", i % 2) for i in range(7)] + [("", 0), (None, 1), ("c", 1)], "text string, label int")
    whole = sorted(map(tuple, count_all(texts).collect()))
    shares = [list(map(tuple, count_all(texts, k, 3).collect())) for k in range(3)]
    assert sorted(sum(shares, [])) == whole and sum(r[2] + r[3] for r in whole) == 36


def test_words_and_pairs_of_a_text_are_counted_once_each():
    numbers = kneser_ney.WordHashes()
    texts = [None, "", "one", "a a", "a b a b c", "c b a"]
    words = [numbers.of(t) for t in texts]
    known = kneser_ney.Known(np.zeros(0, np.int64), np.zeros((0, 4), np.float32))
    got = kneser_ney.ask_some(np.arange(len(texts)), words, known, 0.0).to_pylist()
    wanted = []
    for k, w in enumerate(words):
        before, after = Counter(kneser_ney.words_before(w).tolist()), Counter(w.tolist())
        wanted += [(k, x, after[x], before[x]) for x in before | after]
        wanted += [(k, x, n, -1) for x, n in Counter(kneser_ney.pair_keys(kneser_ney.words_before(w), w).tolist()).items()]
    assert sorted((r["row_tag"], r["key"], r["n"], r["m"]) for r in got if r["sums"] is None) == sorted(wanted)
    assert [r["sums"][2] for r in got if r["sums"] is not None] == [len(w) for w in words]
