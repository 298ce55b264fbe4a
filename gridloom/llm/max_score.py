"""Exact top-k inner-product search by MaxScore over integer vectors.

Terms are the dimensions of a vector; a posting is a candidate's non-zero component. Every query starts
with a bar, the k-th best of its exact scores against a bounded sample of all candidates: whatever scores
less cannot be among its k best. Candidates are dealt by a hash of their id into shards and queries into
blocks, and every (shard, block) pair is one cell. A cell is traversed in blocks of ascending ids, the
first of 2k candidates and each twice as large as the one before, up to a limit. A block has the largest
and smallest component of each term, which bound what a query can gain from it. Blocks whose bounds
together cannot pass the bar are skipped. Else the terms are split: the last ones, whose bounds together
cannot lift a candidate past the bar, are non-essential. Essential postings are traversed for all
candidates of the block; non-essential terms are probed, a few at a time, only for candidates whose
partial score plus the bounds of what is left still competes. Where more than half of the terms are
essential, as is usual for dense vectors, probing saves less than it costs: those queries take the block's
scores in one product. The bar rises after every block. Cells return k candidates for each query, and the
shards' lists are merged.

Exact search compares every query with every shard, so each candidate is sent once for each block of
queries and each query once for each shard: about 5 MB for a cell of 8192 x 2048 pairs.

Scores are exact integers: sums run in float64 while every sum stays below 2**53, else in int64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OUT = "query_id long, vec_id long, score long"


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The type in which all their scores are exact: doubles where they fit."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    return np.float64 if most < 2**53 else np.int64


def sample_bars(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best exact score against a sample, its own id left out; the smallest integer
    where the sample has fewer than k others."""
    out = np.full(len(queries), np.iinfo(np.int64).min)
    kind = _kind(queries, vectors)
    queries, turned = queries.astype(kind), np.ascontiguousarray(vectors.T.astype(kind))
    for at in range(0, len(queries), 512):
        scores = (queries[at:at + 512] @ turned).astype(np.int64)
        own = query_ids[at:at + 512, None] == ids
        enough = (~own).sum(axis=1) >= k
        if vectors.shape[0] >= k:
            scores = np.where(own, np.iinfo(np.int64).min, scores)
            best = np.partition(scores, vectors.shape[0] - k, axis=1)[:, vectors.shape[0] - k]
            out[at:at + 512] = np.where(enough, best, out[at:at + 512])
    return out


def cell_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bars: np.ndarray | None = None,
               block: int | None = None, largest: int = 4096, steps: int = 4) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """The k best candidates of one shard for each query (positions and scores), ties to smaller ids, and
    the number of postings read. Candidates that score less than a query's bar may be left out.

    Candidates come in ascending id order. A candidate with the query's own id takes no part.
    """
    n, width = vectors.shape
    kind = _kind(queries, vectors)
    least = -(2**62)
    rows, q_all = vectors.astype(kind), queries.astype(kind)
    # What a candidate must pass: one less than a bar that it may equal.
    bar = np.full(len(queries), least, dtype=np.int64) if bars is None else np.maximum(bars, least + 1) - 1
    best = [np.zeros(0, dtype=np.int64)] * len(queries)
    won = [np.zeros(0, dtype=np.int64)] * len(queries)
    at, size, read = 0, block or 2 * k, 0

    def take(q: int, live: np.ndarray, score: np.ndarray) -> None:
        live, score = np.concatenate([best[q], live]), np.concatenate([won[q], score.astype(np.int64)])
        top = np.lexsort((ids[live], -score))[:k]
        best[q], won[q] = live[top], score[top]
        if len(top) == k:
            bar[q] = max(bar[q], int(score[top[-1]]))  # later ids must pass it: a tie goes to the smaller id

    while at < n:
        end = min(n, at + size)
        part, here = rows[at:end], ids[at:end]
        high, low = part.max(axis=0, initial=0), part.min(axis=0, initial=0)
        gain = np.maximum(q_all * high, q_all * low)  # the most that each term adds in this block
        asked = np.flatnonzero(gain.sum(axis=1) > bar)
        order = np.argsort(-gain[asked], axis=1, kind="stable")
        rest = np.cumsum(np.take_along_axis(gain[asked], order, axis=1)[:, ::-1], axis=1)[:, ::-1]  # what terms from here on add at most
        essential = (rest > bar[asked, None]).sum(axis=1)
        whole = (2 * essential > width) | (bar[asked] == least)
        for lo in range(0, int(whole.sum()), 256):
            some = asked[whole][lo:lo + 256]
            scores = q_all[some] @ part.T
            read += scores.size * width
            hit = (scores > bar[some, None]) & (here != query_ids[some, None])
            for i in np.flatnonzero(hit.any(axis=1)):
                live = np.flatnonzero(hit[i])
                take(some[i], live + at, scores[i, live])
        for i in np.flatnonzero(~whole):
            q, done, terms = asked[i], int(essential[i]), order[i]
            live = np.flatnonzero(here != query_ids[q])
            score = part[live][:, terms[:done]] @ q_all[q, terms[:done]]
            read += done * len(live)
            bound, step = np.append(rest[i], 0), max(1, -(-(width - done) // steps))
            while True:
                keep = score + bound[done] > bar[q]
                live, score = live[keep], score[keep]
                if done == width or not len(live):
                    break
                more = terms[done:done + step]
                score = score + part[np.ix_(live, more)] @ q_all[q, more]
                read += len(live) * len(more)
                done += len(more)
            if len(live):
                take(q, live + at, score)
        at, size = end, min(2 * size, largest)
    return best, won, read


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 8192, block_rows: int = 2048, sample_rows: int = 2048) -> DataFrame:
    """The k candidates of highest inner product for each query: query_id, rank, vec_id, score.

    Both frames have ``vec_id`` and ``vector`` (array of long). Ties go to the smaller vec_id; a query
    never matches rows of its own id; every candidate row counts, repeated ones too, while queries
    repeated as a whole count once (queries that share an id share one list); shorter vectors, and empty
    ones, count as padded with zeros. A query with fewer candidates gets all of them; with none, no row. An empty
    frame gives an empty result. Null ids take no part.

    Cells hold about ``shard_rows`` candidates and ``block_rows`` queries, whatever the input's size. The first
    bars come from at most ``sample_rows`` candidates, chosen by a hash of the id; all candidates are searched.
    """
    spark = candidates.sparkSession
    candidates = candidates.where("vec_id is not null").select("vec_id", "vector")
    queries = queries.where("vec_id is not null").select("vec_id", "vector").distinct()
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    some = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()  # bounded
    width = int(some["vector"].map(len).max()) if len(some) else 0
    sample_ids, sample = some["vec_id"].to_numpy(np.int64), _matrix(some["vector"], width)

    def barred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wide = max([width, *frame["vector"].map(len)])
            padded = np.pad(sample, ((0, 0), (0, wide - width)))
            yield frame.assign(bar=sample_bars(frame["vec_id"].to_numpy(np.int64), _matrix(frame["vector"], wide), sample_ids, padded, k))

    queries = queries.mapInPandas(barred, "vec_id long, vector array<long>, bar long")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = (candidates.withColumn("shard", deal(shards))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (queries.withColumn("block", deal(blocks))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def cell(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        width = max(own["vector"].map(len).max(), asked["vector"].map(len).max())

        order = np.argsort(own["vec_id"].to_numpy(np.int64), kind="stable")
        ids, vectors = own["vec_id"].to_numpy(np.int64)[order], _matrix(own["vector"], width)[order]
        query_ids = asked["vec_id"].to_numpy(np.int64)
        places, scores, _ = cell_top_k(query_ids, _matrix(asked["vector"], width), ids, vectors, k, asked["bar"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": np.repeat(query_ids, [len(p) for p in places]),
                             "vec_id": ids[np.concatenate(places)], "score": np.concatenate(scores)})

    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, _OUT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector: floor(factor * x) of every component. Rows whose vector is null or holds
    a null or non-finite component take no part; an empty vector has none and does."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("d", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("d"))
            .where(F.col("d").isNotNull()).where(~bad)
            .select("vec_id", F.transform("d", lambda x: F.floor(x * F.lit(float(factor)))).alias("vector")))


def top_k_query(rows: DataFrame, k: int = 20) -> DataFrame:
    vectors = integer_vectors(rows)
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k)
