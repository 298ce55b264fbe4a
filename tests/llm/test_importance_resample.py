"""Importance resampling against plain counting, with cut texts, odd rows and ranks over many ranges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance_resample as resample

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def features(text, order=2, buckets=10_000):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    grams = [" ".join(words[i:i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def plain(docs, target):
    """doc_id, n_features, weight, score, rank, as stated."""
    own, wanted = [(i, *features(t)) for i, t in docs], [features(t)[1] for _, t in target]
    s, t = sum((c for _, _, c in own), Counter()), sum(wanted, Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0)))) for b in range(10_000)}
    rows = []
    for i, n_words, counts in own:
        n = sum(counts.values())
        weight = sum(gain[b] * k for b, k in counts.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    apt = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = 25 * len(apt) // 100
    rank = {id(r): k + 1 for k, r in enumerate(apt[:drawn])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def corpus(n=260, seed=2):
    r = random.Random(seed)
    words = ["Alpha", "beta", "É", "été", "東京", "x1", "don't", "a_b", "under", "\x00", "naïve", "The", "of", "9", "ÀB", " ", "z\tz"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 5, 19, 20, 21, 60, 200))))) for i in range(n)]
    target = [(i, " ".join(r.choice(words[:6]) for _ in range(40))) for i in range(9)]
    return docs, target


def got(spark, docs, target):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rank", "low", "apt", "score", "row", "buckets", "n_words")})
    rows = resample.importance(frame, spark.createDataFrame(target, "item_id long, text string")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_scores_and_ranks_equal_plain_counting(spark):
    docs, target = corpus()
    docs += [(900, None), (901, ""), (902, "!!! ..."), (903, "One"), (None, "no id " * 30)]
    assert got(spark, docs, target) == plain(docs, target)


def test_repeated_rows_are_ranked_one_after_another(spark):
    docs, target = corpus(40)
    docs += [docs[-1]] * 3 + [(50, "Alpha beta " * 30)] * 60
    rows = got(spark, docs, target)
    assert rows == plain(docs, target)
    ranks = sorted(r[4] for r in rows if r[4])
    assert ranks == list(range(1, len(ranks) + 1))


def test_empty_tables(spark):
    docs, target = corpus(30)
    assert got(spark, [], target) == []
    assert got(spark, docs, []) == plain(docs, [])
    none = spark.createDataFrame(docs, "doc_id long, text string").where("false")
    assert resample.resampled(none, none, target_id_col="doc_id").count() == 0


def test_drawn_documents_come_back_whole(spark):
    docs, target = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("x"))
    want = {r[0] for r in plain(docs, target) if r[4]}
    out = resample.resampled(frame, spark.createDataFrame(target, "item_id long, text string"))
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == want


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_cut_texts_count_the_same(monkeypatch, order):
    monkeypatch.setattr(resample, "_SLICE", 300)
    docs, _ = corpus(60)
    docs += [(100, "long " * 400 + "w" * 9000 + " end of it"), (101, "w" * 20_000), (102, " " * 2000 + "a"), (103, "É" * 200 + " b" * 900)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    rows = [r for out in resample._counted(order, 97)(iter([batch])) for r in out.to_pylist()]
    totals = rows.pop()["totals"]
    assert [r["doc_id"] for r in rows] == [d for d, _ in docs]
    every = Counter()
    for r, (_, text) in zip(rows, docs):
        n_words, counts = features(text, order, 97)
        assert (r["n_words"], r["n_features"], dict(zip(r["buckets"], r["counts"]))) == (n_words, sum(counts.values()), dict(counts))
        every += counts
    assert totals == [every[b] for b in range(97)]


def test_gains_floor_down():
    assert resample.gains(np.array([0, 9]), np.array([9, 0])).tolist() == [math.floor(1000 * math.log(10)), math.floor(-1000 * math.log(10))]
