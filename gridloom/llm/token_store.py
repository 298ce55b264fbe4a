"""Token output as directly addressable codes.

Ids are split into chunks of 8 bits, least significant first. Level 0 has a chunk of every id, level
k the k-th chunk of the ids that reach so far. A bitmap beside each level marks ids that go on, and a
rank directory (ones before every 512th bit) leads from a position to its place a level further, so
any id, or the ids of any document, are read without decoding what stands before them.

A segment (one row of the written table, the unit of the file format) holds whole documents:
``payload`` is

    magic "DAC1" | u32 levels | u64 ids | per level: u64 length, chunks, bitmap, rank directory (u32)

Segments carry a document directory (``doc_ids`` and ``doc_ends``), the part they belong to and the
number of ids before them there, so the place of a document among all ids is known from small columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.chunk_tokens import loaded
from gridloom.llm.common import shared_dir, slices

_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)
SEGMENT_SCHEMA = "part int, seg int, before long, n_tokens long, doc_ids array<bigint>, doc_ends array<bigint>, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // _BLOCK) * (_BLOCK // 8), dtype=np.uint8)
        padded[:len(bits)] = bits
        ones = _ONES[padded].reshape(-1, _BLOCK // 8).sum(axis=1)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes() + padded.tobytes() + rank.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    return b"DAC1" + struct.pack("<IQ", len(levels), len(ids)) + b"".join(struct.pack("<Q", n) + body for n, body in levels)


class DacReader:
    """Random access to the ids of one segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        count, self.n = struct.unpack_from("<IQ", payload, 4)
        at, self.levels = 16, []
        for _ in range(count):
            n, = struct.unpack_from("<Q", payload, at)
            blocks = -(-n // _BLOCK)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, blocks * (_BLOCK // 8), at + 8 + n)
            rank = np.frombuffer(payload, "<u4", blocks + 1, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * (blocks + 1)
            self.levels.append((chunks, bits, rank))

    def _rank(self, level: int, at: int) -> int:
        _, bits, rank = self.levels[level]
        block = at // _BLOCK
        whole = bits[block * (_BLOCK // 8):at // 8]
        last = int(_ONES[bits[at // 8] & ((1 << at % 8) - 1)]) if at % 8 else 0
        return int(rank[block]) + int(_ONES[whole].sum()) + last

    def token(self, at: int) -> int:
        """The id at one position."""
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << shift
            if not bits[at // 8] >> at % 8 & 1:
                break
            at, shift = self._rank(level, at), shift + 8
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions start to stop; reads only their chunks."""
        out = np.zeros(max(0, stop - start), dtype=np.uint32)
        where, lo, hi = None, start, stop
        for level, (chunks, bits, _) in enumerate(self.levels):
            if lo >= hi:
                break
            part = chunks[lo:hi].astype(np.uint32) << (8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            more = np.unpackbits(bits[lo // 8:-(-hi // 8)], bitorder="little")[lo % 8:lo % 8 + hi - lo].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            lo = self._rank(level, lo) if len(where) else 0
            hi = lo + len(where)
        return out


def _segments(path: str, kind: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, before = TaskContext.get().partitionId(), 0, 0
        tokens, end = loaded(path, kind), struct.pack("<I", end_id)
        ids, docs, ends, held = [], [], [], 0

        def flush():
            nonlocal seg, before, held
            payload = dac_encode(np.frombuffer(b"".join(ids), "<u4"))
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "before": pa.array([before], pa.int64()),
                "n_tokens": pa.array([held], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "doc_ends": pa.array([ends], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary())})
            seg, before, held = seg + 1, before + held, 0
            ids.clear(), docs.clear(), ends.clear()
            return row

        for batch in slices(batches, 1000):
            for doc, own in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist())):
                ids.append(own + end)
                held += len(own) // 4 + 1
                docs.append(doc)
                ends.append(held)
                if held >= segment_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, kind: str, end_id: int, segment_tokens: int = 1_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending id order.

    A null text is an empty one and gives the end id alone; a null document id sorts first; rows with
    the same id stand in order of their text's hash; an empty table gives an empty store. Other
    columns are ignored. A segment ends after the document that brings it to ``segment_tokens`` ids.
    """
    spark = docs.sparkSession
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
               .repartitionByRange(F.col("doc").asc_nulls_first())
               .sortWithinPartitions(F.col("doc").asc_nulls_first(), F.xxhash64("text")))
    ordered.mapInArrow(_segments(path, kind, end_id, segment_tokens), SEGMENT_SCHEMA).write.mode("overwrite").parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids
    (little-endian unsigned 32-bit). Each document is read by its place, through the rank directories."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(out)
    # One row for each part, that is for each writing task: a bounded table, whatever the input.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = segments.join(F.broadcast(bases), "part")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                reader, first = DacReader(row["payload"]), row["base"] + row["before"]
                ends = np.array(row["doc_ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), 500):
                    lo, hi = starts[at:at + 500], ends[at:at + 500]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(row["doc_ids"][at:at + 500], pa.int64()), "start": pa.array(first + lo, pa.int64()),
                        "n_tokens": pa.array(hi - lo, pa.int64()),
                        "ids": pa.array([reader.tokens(a, b).astype("<u4").tobytes() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())})

    return placed.select("base", "before", "doc_ids", "doc_ends", "payload").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids binary")


def token_store_query(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write, read back and digest: doc_id, start, n_tokens, ids_crc32."""
    out = f"{shared_dir(spark)}/tokens"
    write_tokens(docs, out, path, "word", end_id=1)
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
