"""Packing by power-of-two decomposition.

A document of n ids is cut from its start into as many pieces of ``max_len`` as fit and then into the
binary digits of the rest, longest first. Every piece is a sequence of its own, whose length is a
power of two, so no sequence crosses documents and none is padded. Pieces of equal length form a
bucket; sequence ids run through one bucket after another, longest first, so a batch of equal shapes
is a range of ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.chunk_tokens import loaded
from gridloom.llm.common import slices, written

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, row long"


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n ids: max_len as often as it fits, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 1, max_len: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian unsigned 32-bit).

    A document is the ids of its text, then ``end_id``; a null text is an empty one and gives one
    piece with the end id alone. A null document id is kept; rows with the same id are packed each for
    itself. An empty table gives no pieces. Other columns are ignored.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len is a power of two")
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens, end = TaskContext.get().partitionId(), loaded(path, kind), struct.pack("<I", end_id)
        seen: dict[int, int] = {}
        for some in slices(batches):
            if some.num_rows:
                rows: list[tuple] = []
                for doc, own in zip(some.column(0).to_pylist(), tokens.encode(some.column(1).to_pylist())):
                    own += end
                    n, start = len(own) // 4, 0
                    for length in piece_lengths(n, max_len):
                        row = seen.get(length, 0)
                        seen[length] = row + 1
                        rows.append((doc, start, length, n, own[4 * start:4 * (start + length)], part, row))
                        start += length
                if rows:
                    doc, start, length, n, ids, parts, row = zip(*rows)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                        "doc_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary()), "part": pa.array(parts, pa.int32()),
                        "row": pa.array(row, pa.int64())})

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # Written once: the row numbers within a part stay as they are, whatever is lost later.
    cut = written(spark, source.mapInArrow(pieces, PIECE_SCHEMA), name="pieces")
    # A row for each part and bucket: at most log2(max_len) + 1 for each writing task.
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("length"), "part")) - F.col("n")
    bases = counts.select("length", "part", before.alias("base"))
    return (cut.join(F.broadcast(bases), ["length", "part"])
            .select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("row")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), "ids"))


def packing_query(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
