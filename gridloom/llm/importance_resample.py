"""Target-distribution importance resampling by hashed n-grams, counted with DuckDB in every partition.

Each task has a DuckDB connection of its own. SQL unnests the words of a slice of texts, windows them into
n-grams, hashes these with zlib's crc32 (registered as a function) and counts the buckets of each document.
The counts leave DuckDB as Arrow and are spilled to Parquet by Spark in the shared folder (DuckDB itself
reaches only local files, which other executors would not see): a row for each document, and one with the
totals of each task. Spark merges the totals, a gain for each bucket follows from them, and the spilled
counts are scored; texts are read once.

Texts are lower-cased and their separators made spaces byte by byte before DuckDB has them, and are
given to it in slices of bounded size; a longer text is cut between words, each piece with the first
words of the next, and its counts are added up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import running, shared_dir, written

_SLICE = 2_000_000
SPILL_SCHEMA = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>, totals array<bigint>"
#: Bytes of words stay (A-Z in lower case, all beyond ASCII as they are), the others become spaces.
_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], dtype=np.uint8)


def _sql(order: int, buckets: int) -> str:
    grams = [" || ' ' || ".join(["word", *[f"lead(word, {k}) OVER w" for k in range(1, n + 1)]]) for n in range(order)]
    return f"""
WITH words AS (
  SELECT doc, own, word, row_number() OVER (PARTITION BY doc ORDER BY place) AS nth
  FROM (SELECT doc, own, unnest(parts) AS word, generate_subscripts(parts, 1) AS place FROM (SELECT doc, own, string_split(text, ' ') AS parts FROM pieces))
  WHERE word <> ''),
grams AS (SELECT doc, nth, own, unnest([{', '.join(grams)}]) AS gram FROM words WINDOW w AS (PARTITION BY doc ORDER BY nth)),
hashed AS (SELECT doc, zlib_crc32(gram) % {buckets} AS bucket FROM grams WHERE gram IS NOT NULL AND nth <= own)
SELECT doc, CAST(bucket AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM hashed GROUP BY ALL ORDER BY doc, bucket"""


def _crc32(grams) -> pa.Array:
    """zlib's crc32 of each string's UTF-8 bytes, cut from the vector's own buffer."""
    out = []
    for grams in grams.chunks if isinstance(grams, pa.ChunkedArray) else [grams]:
        _, ends, data = grams.cast(pa.string()).buffers()
        ends = np.frombuffer(ends, np.int32)[grams.offset:grams.offset + len(grams) + 1].tolist()
        cut = map((data.to_pybytes() if data else b"").__getitem__, map(slice, ends[:-1], ends[1:]))
        out.append(np.fromiter(map(zlib.crc32, cut), np.int64, len(grams)))
    return pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int64))


class _Counter:
    """Bucket counts of slices of texts, by a DuckDB connection."""

    def __init__(self, order: int, buckets: int):
        import duckdb
        from duckdb.sqltypes import BIGINT, VARCHAR

        self.order, self.sql = order, _sql(order, buckets)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.con.create_function("zlib_crc32", _crc32, [VARCHAR], BIGINT, type="arrow")

    def counts(self, rows: list[int], texts: list[bytes], own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, buckets and counts, ascending; ``own`` is the number of words that start n-grams."""
        pieces = pa.table({"doc": pa.array(rows, pa.int64()), "own": pa.array(own, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})
        self.con.register("pieces", pieces)
        found = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("pieces")
        return tuple(found.column(k).to_numpy() for k in range(3))


def _pieces(text: bytes, order: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces, cut at spaces, with the number of words of each; the first words of what follows are added."""
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + _SLICE)
        end = len(text) if cut < 0 else cut
        size, ahead = 4096, []
        while len(ahead) < order and end < len(text):  # one word more than needed, so none is cut
            ahead = text[end:end + size].split()
            if end + size >= len(text):
                break
            size *= 4
        own = text[at:end]
        yield b" ".join([own, *ahead[:order - 1]]), len(own.split())
        at = end


def _counted(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals = _Counter(order, buckets), np.zeros(buckets, dtype=np.int64)

        def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

        def rows(ids: pa.Array, words: list[int], at: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ends = np.searchsorted(at, np.arange(len(words) + 1))
            np.add.at(totals, bucket, n)
            features = [sum(max(0, w - k) for k in range(order)) for w in words]
            return pa.RecordBatch.from_pydict({
                "doc_id": ids, "n_words": pa.array(words, pa.int64()), "n_features": pa.array(features, pa.int64()),
                "buckets": lists(bucket, ends), "counts": lists(n, ends), "totals": pa.nulls(len(words), pa.list_(pa.int64()))})

        for batch in batches:
            ids = batch.column(0)
            texts = [_BYTES[np.frombuffer(t.as_buffer(), np.uint8)].tobytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _SLICE):
                    size, end = size + len(texts[end]), end + 1
                if size <= _SLICE:
                    words = [len(t.split()) for t in texts[at:end]]
                    yield rows(ids[at:end], words, *counter.counts(list(range(end - at)), texts[at:end], words))
                else:  # one long text
                    held, words = np.zeros(buckets, dtype=np.int64), 0
                    for piece, own in _pieces(texts[at], order):
                        _, bucket, n = counter.counts([0], [piece], [own])
                        held[bucket] += n
                        words += own
                    bucket = np.flatnonzero(held)
                    yield rows(ids[at:end], [words], np.zeros(len(bucket), dtype=np.int64), bucket, held[bucket])
                at = end
        empty = pa.array([[]], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(1, pa.int64()), "n_words": pa.nulls(1, pa.int64()), "n_features": pa.nulls(1, pa.int64()),
            "buckets": empty, "counts": empty, "totals": pa.array([totals.tolist()], pa.list_(pa.int64()))})

    return run


def spilled_counts(docs: DataFrame, folder: str, name: str, order: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bucket counts of every document and, in rows of their own, the totals of every task."""
    source = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    source.mapInArrow(_counted(order, buckets), SPILL_SCHEMA).write.parquet(f"{folder}/{name}")
    return docs.sparkSession.read.schema(SPILL_SCHEMA).parquet(f"{folder}/{name}")


def merged_totals(spilled: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all documents: at most ``buckets`` numbers."""
    out = np.zeros(buckets, dtype=np.int64)
    for row in spilled.where("totals is not null").select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[row["pos"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of each bucket, with one feature added to every bucket."""
    all_s, all_t, k = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: ((t + 1.0) * (all_s + float(k))) / ((s + 1.0) * (all_t + float(k)))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, n = batch.column(3), batch.column(4)
            sizes = bucket.value_lengths().to_numpy(zero_copy_only=False)
            each = gain[bucket.flatten().to_numpy()] * n.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            running_ = np.concatenate([[0], np.cumsum(each)])
            features = batch.column(2).to_numpy()
            weight = (running_[ends[1:]] - running_[ends[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def importance(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, order: int = 2, buckets: int = 10_000,
               seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, by likeness to ``target``.

    Features are the word n-grams of 1 to ``order`` words, hashed to ``buckets``. A document's weight is the
    floored mean gain of its features (none: 0); its score adds a Gumbel number drawn from the id, so the
    ``percent`` of highest scores among documents of at least ``min_words`` words are a sample by weight
    without replacement. They have ranks 1, 2, ...; the others have none. Ties go to the smaller id.

    Null texts are empty. A null id counts as an empty text in the draw and comes first among ties. Repeated
    rows are documents of their own and are ranked one after another. Empty tables count nothing; without
    documents there are no rows. Columns of other names are ignored.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    spilled = spilled_counts(docs, folder, "source", order, buckets, id_col, text_col)
    wanted = spilled_counts(target, folder, "target", order, buckets, target_id_col, target_text_col)
    gain = gains(merged_totals(spilled, buckets), merged_totals(wanted, buckets))
    weighed = spilled.where("totals is null").mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + gumbel)
    scored = written(spark, scored.withColumns({"apt": (F.col("n_words") >= min_words).cast("long"), "low": -F.col("score")}), folder, "scored")
    drawn = percent * (scored.agg(F.sum("apt")).first()[0] or 0) // 100
    ranked = running(spark, scored.where("apt = 1"), [], ["low", "doc_id"], {"rank": ("sum", "apt")}, folder, "ranked")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = ranked.unionByName(scored.where("apt = 0").withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, with all their columns. Rows that share an id come together if one of them is drawn."""
    drawn = importance(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col("doc_id").alias("drawn id")).distinct()
    return docs.join(drawn, F.col(f"`{id_col}`").eqNullSafe(F.col("drawn id")), "left_semi")


def importance_query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
