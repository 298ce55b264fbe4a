"""N-gram Jaccard join by parity sketches.

A document is the set of its 64-bit shingle hashes. Two sets link when their Jaccard similarity is at
least t, so they differ in at most (1 - t) / (1 + t) times the sum of their sizes. Pairs are banded by
that sum; a band's largest sum gives the largest difference ``d`` of its linking pairs. For a band, hash
space is parted into ``m`` blocks and a block's parity sketch has one bit for every hash value, flipped
by each token of the block; it is kept as the XOR of the hashes of its set bits. Each token of the
symmetric difference changes one block at most, so the number of unequal blocks, like the Hamming
distance, never exceeds the symmetric difference: of m = d + spare + need blocks of a linking pair at
least spare + need are equal (pigeonhole). Keys are (band, block, sketch). Blocks without a set bit are
alike in too many documents and give no key; a document with more than ``spare`` of them also gives the
keys of a second partition, and if that fails too, of a third with all its blocks. So every linking pair
shares at least ``need`` keys of one partition.

That number prunes before any pair is made: a document whose keys are shared by others less than
``need`` times in a partition goes, and of the others' keys the ``need - 1`` most frequent of each
partition go (two sets that share ``need`` keys still share the rarest of them). Pairs of what is left
are tested by size, by the Hamming distance of whole-set bit sketches, then by exact intersection.

Members of a key's group are compared with one hub first; what links is contracted, and groups left with
one component are done. At the others, members outside the group's largest component are compared with
the rest in blocks of bounded size, each pair of blocks for itself, and only pairs whose sizes and bit
sketches leave a link possible become rows: a member's closest ones first, and all that are left in the end. Components are kept by contraction.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Known, drop_dir, merged_labels, own_session, shared_dir, written

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15))
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SKETCH = [f"s{k}" for k in range(8)]
_SLICES = 4
_BAND = 1.4
_DESCRIBED = "slice int, doc long, n long, mark binary, keys array<bigint>"
_ROWS = 250


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_HASHES = Known(_word_hash, 1_000_000)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: ``width`` words, A-Z lower-cased; a shorter text
    is one shingle; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = out * _MIX[2] + hashes[k:len(words) - size + 1 + k]
    return np.unique(_mixed(out))


@functools.lru_cache(maxsize=None)
def _bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each band of size sums: the largest sum, the largest symmetric difference of a linking pair,
    the blocks without a set bit that a document may have, and the keys that a linking pair shares."""
    top = [2]
    while top[-1] < 2**40:
        top.append(max(top[-1] + 1, int(top[-1] * _BAND)))
    top = np.array(top, dtype=np.int64)
    differ = top * (100 - percent) // (100 + percent)
    need = np.minimum(31, 1 + -(-differ // 16))
    least = top / _BAND / (1 + 100 / percent)  # the smallest set with a partner in the band
    spare = np.ones(len(top), dtype=np.int64)
    for _ in range(6):  # blocks without tokens to be expected of that set, and two standard deviations
        blocks = differ + spare + need
        empty = blocks * np.exp(-least / blocks)
        spare = np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64)
    return top, differ, spare, need


def _block_sketches(tokens: np.ndarray, bits: np.ndarray, blocks: int) -> np.ndarray:
    """XOR of ``bits`` of the (sorted) tokens of each block."""
    at = (((tokens >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros(blocks, dtype=np.uint64)
    out[at[starts]] = np.bitwise_xor.reduceat(bits, starts)
    return out


def _keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """All keys of a set. The low 4 bits name the partition (band modulo 4, number), the next 5 ``need``."""
    top, differ, spare, need = _bands(percent)
    n = len(tokens)
    first, last = np.searchsorted(top, [n - (-percent * n // 100), n + 100 * n // percent])
    turns, out = [(tokens, _mixed(tokens))], []
    for band in range(int(first), int(last) + 1):
        d, e, g = int(differ[band]), int(spare[band]), int(need[band])
        if not d:
            continue  # only equal sets link, and those are one
        for turn in range(3):
            if turn == len(turns):
                again = np.sort(_mixed(turns[-1][0] ^ _MIX[2]))
                turns.append((again, _mixed(again)))
            blocks = d + g + (e if turn < 2 else 0)
            sketches = _block_sketches(*turns[turn], blocks)
            at = np.flatnonzero(sketches) if turn < 2 else np.arange(blocks)
            place = at.astype(np.uint64) * np.uint64(4) + np.uint64(turn) + (np.uint64(band) << np.uint64(48))
            out.append((_mixed(_mixed(place) ^ sketches[at]) << np.uint64(9)) | np.uint64(g * 16 + (band % 4) * 4 + turn))
            if blocks - len(at) <= e:
                break
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _fingerprint(tokens: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _described(width: int, percent: int):
    """For each text a row of slice -1 with the set's size and fingerprint, and its keys by slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                docs = some.column(0)
                sets = [shingle_set(t, width) for t in some.column(1).to_pylist()]
                keys = [_keys(s, percent) if len(s) else np.zeros(0, dtype=np.uint64) for s in sets]
                nothing = pa.nulls(len(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(np.full(len(sets), -1, dtype=np.int32)), "doc": docs, "n": pa.array([len(s) for s in sets], pa.int64()),
                    "mark": pa.array([_fingerprint(s) for s in sets], pa.binary()), "keys": nothing})
                parts = [(k >> np.uint64(9)) % np.uint64(_SLICES) for k in keys]
                for part in range(_SLICES):
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array(np.full(len(sets), part, dtype=np.int32)), "doc": docs, "n": pa.nulls(len(sets), pa.int64()),
                        "mark": pa.nulls(len(sets), pa.binary()), "keys": _lists([k[p == part] for k, p in zip(keys, parts)])})

    return run


def _sets(width: int):
    """doc, mark, n, tokens and the whole set's bit sketch (8 blocks of 64 bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                sets = [shingle_set(t, width) for t in some.column(1).to_pylist()]
                sketch = np.zeros((len(sets), len(_SKETCH)), dtype=np.uint64)
                for row, tokens in zip(sketch, sets):
                    if len(tokens):
                        row[:] = _block_sketches(tokens, np.uint64(1) << (tokens & np.uint64(63)), len(_SKETCH))
                yield pa.RecordBatch.from_pydict({
                    "doc": some.column(0), "mark": pa.array([_fingerprint(s) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": _lists(sets),
                    **{name: pa.array(sketch[:, k].view(np.int64)) for k, name in enumerate(_SKETCH)}})

    return run


def pairs_in_slices(left: np.ndarray, right: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of the lists of two columns, row by row, given the lists' lengths; about
    ``most`` pairs at once."""
    each = np.repeat(right, left)  # pairs of each element on the left
    first = np.repeat(np.cumsum(right) - right, left)
    ends = np.cumsum(each)
    at = 0
    while at < len(each):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - each[at] + most, side="right")))
        n = each[at:end]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(np.arange(at, end), n), np.repeat(first[at:end], n) + within
        at = end


def _compared(percent: int, most: int | None):
    """Pairs of different components whose sizes and bit sketches leave a link possible; of each member on the
    left the ``most`` closest by sketch, if not all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[c.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4 + len(_SKETCH))] for c in batch.columns]
            lengths = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            (doc_x, comp_x, size_x, n_x, *bits_x), (doc_y, comp_y, size_y, n_y, *bits_y) = columns
            for i, j in pairs_in_slices(*lengths):
                keep = (size_x[i] < size_y[j]) | ((size_x[i] == size_y[j]) & (comp_x[i] < comp_y[j]))
                keep &= 100 * np.minimum(n_x[i], n_y[j]) >= percent * np.maximum(n_x[i], n_y[j])
                i, j = i[keep], j[keep]
                apart = np.zeros(len(i), dtype=np.int64)
                for x, y in zip(bits_x, bits_y):
                    apart += np.bitwise_count((x[i] ^ y[j]).view(np.uint64))
                near = apart * (100 + percent) <= (100 - percent) * (n_x[i] + n_y[j])
                i, j, apart = i[near], j[near], apart[near] / (n_x[i[near]] + n_y[j[near]])
                if most is not None:
                    order = np.lexsort((apart, i))
                    i, j = i[order], j[order]
                    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, dtype=np.int64)
                    place = np.arange(len(i)) - np.repeat(first, np.diff(np.concatenate([first, [len(i)]])))
                    i, j = i[place < most], j[place < most]
                a, b = doc_x[i], doc_y[j]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _view() -> Column:
    return F.col("key").bitwiseAND(F.lit(15))


def _need() -> Column:
    return F.shiftrightunsigned("key", 4).bitwiseAND(F.lit(31))


def _candidates(spark, folder: str, described, own: DataFrame) -> DataFrame:
    """key, doc, c: keys that may bring a linking pair together, their documents and how many those are."""
    lead = written(spark, own.where("doc = node").select("doc").distinct(), folder, "lead")
    for part in range(_SLICES):  # one after another, so the shuffles of one slice are all that is on disk
        keyed = described().where(F.col("slice") == part).join(lead, "doc", "left_semi").select("doc", F.explode("keys").alias("key"))
        # Most keys are one document's alone; counts (combined on the map side) leave the others.
        shared = keyed.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("c")).where("low < high").select("key", "c")
        # Written first: a join that reads two plain exchanges is one whose hot keys Spark can split.
        shared = written(spark, shared, folder, f"shared{part}")
        keyed.join(shared, "key").write.parquet(f"{folder}/met/slice={part}")
        drop_dir(spark, f"{folder}/described/slice={part}")
    met = spark.read.schema("doc long, key long, c long").parquet(*[f"{folder}/met/slice={part}" for part in range(_SLICES)])
    one = Window.partitionBy("doc", _view())
    kept = met.select("*", F.row_number().over(one.orderBy(F.desc("c"), "key")).alias("place"), F.count("*").over(one).alias("all"))
    kept = written(spark, kept.where((F.col("all") >= _need()) & (F.col("place") >= _need())).select("key", "doc"), folder, "kept")
    drop_dir(spark, f"{folder}/met")
    groups = kept.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("c")).where("low < high").select("key", "c")
    return written(spark, kept.join(written(spark, groups, folder, "groups"), "key"), folder, "members")


def linked_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                      block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for every row of ``docs``.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets.
    ``component_id`` is the smallest id reachable by links. ``n_links`` counts the different texts'
    sets found linked with the row's set in the comparisons made (pairs that are already connected
    through others are not compared). A text that is null or has no words has no shingles and links
    with nothing; rows with equal sets are always together; rows with a null id link with nothing and
    have a null component; rows that repeat an id form one component. An empty table gives no rows.
    Columns of other names are ignored. ``block`` is the number of members of a key's group that one block
    holds, about.
    """
    user, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    spark = own_session(user)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    source.mapInArrow(_described(width, percent), _DESCRIBED).write.partitionBy("slice").parquet(f"{folder}/described")
    described = lambda: spark.read.schema(_DESCRIBED).parquet(f"{folder}/described")
    rows = described().where("slice = -1").select("doc", "n", "mark")
    # A set goes by its smallest document, ``node``; ``mark`` is the set's 128-bit fingerprint.
    nodes = rows.where("mark is not null and doc is not null").groupBy("mark").agg(F.min("doc").alias("node"))
    nodes = written(spark, nodes, folder, "nodes")
    own = written(spark, rows.join(nodes, "mark", "left").select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("node")).alias("node")), folder, "own")
    members = _candidates(spark, folder, described, own)
    drop_dir(spark, f"{folder}/described")
    labels = written(spark, members.select("doc").distinct().select("doc", F.col("doc").alias("comp")), folder, "labels")
    # Whole sets are made once, of the documents that are left.
    wanted = user.read.schema(labels.schema).parquet(f"{folder}/labels").select("doc")
    shape = f"doc long, mark binary, n long, tokens array<bigint>, {', '.join(f'{s} long' for s in _SKETCH)}"
    written(user, source.join(wanted, "doc", "left_semi").mapInArrow(_sets(width), shape), folder, "raw")
    sets = spark.read.schema(shape).parquet(f"{folder}/raw").where("n > 0").dropDuplicates(["doc", "mark"]).drop("mark")
    sets = written(spark, sets, folder, "sets")
    drop_dir(spark, f"{folder}/raw")

    def side(x: str, *columns: str) -> DataFrame:
        return sets.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    def near(a: str, b: str) -> Column:
        """Sizes and the Hamming distance of bit sketches leave a link possible."""
        n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
        apart = sum((F.bit_count(F.col(f"{s}_{a}").bitwiseXOR(F.col(f"{s}_{b}"))).cast("long") for s in _SKETCH), F.lit(0).cast("long"))
        return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (apart * (100 + percent) <= (100 - percent) * (n_a + n_b))

    def linked(close: DataFrame, name: str) -> DataFrame:
        """Pairs that link, by exact intersection."""
        common = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
        exact = close.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b").where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common))
        return written(spark, exact.select("a", "b").distinct(), folder, name)

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc").alias("h"), F.col("doc").alias("hub"))).alias("first")).select("key", "first.hub")
    pairs = members.join(written(spark, first, folder, "hubs"), "key").where("doc <> hub").select(*ordered("doc", "hub")).distinct()
    close = pairs.join(side("a", "n", *_SKETCH), "a").join(side("b", "n", *_SKETCH), "b").where(near("a", "b")).select("a", "b").distinct()
    tested = close = written(spark, close, folder, "close0")
    links = found = linked(close, "links0")
    labels = merged_labels(spark, folder, "merge0", labels, found)
    # Of two components the smaller one (by size, then label) is compared with what is left of a key's group.
    # At first only a member's closest partners are verified: most of what links is then connected, and the
    # last round, which verifies every pair that may link, finds few groups open.
    for turn, most in enumerate((1, 16, None), 1):
        sizes = written(spark, labels.groupBy("comp").agg(F.count("*").alias("size")), folder, f"sizes{turn}")
        weighed = written(spark, labels.join(sizes, "comp").select("doc", "comp", "size"), folder, f"weighed{turn}")
        now = members.select("key", "doc").join(weighed, "doc")
        still = now.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"))
        still = written(spark, still.where("low < high").select("key", F.col("top.comp").alias("main"), F.ceil(F.col("c") / block).cast("int").alias("blocks")), folder, f"open{turn}")
        placed = written(spark, now.join(still, "key").join(sets.drop("tokens"), "doc"), folder, f"placed{turn}").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
        row = F.collect_list(F.struct("doc", "comp", "size", "n", *_SKETCH))  # about ``block`` members
        left = placed.where("comp <> main").groupBy("key", "block").agg(row.alias("x")).select("key", "x")
        right = placed.groupBy("key", "block").agg(row.alias("y")).select("key", "y")
        left, right = written(spark, left, folder, f"left{turn}"), written(spark, right, folder, f"right{turn}")
        close = left.join(right, "key").select("x", "y").mapInArrow(_compared(percent, most), "a long, b long").distinct()
        close = written(spark, close.join(tested, ["a", "b"], "left_anti"), folder, f"close{turn}")
        found = linked(close, f"links{turn}")
        tested, links = tested.unionByName(close), links.unionByName(found)
        labels = merged_labels(spark, folder, f"merge{turn}", labels, found)

    # Rows that repeat an id belong together whatever their texts are.
    alike = own.where("doc is not null and node is not null").groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    alike = written(spark, own.join(alike.select("doc", "a"), "doc").where("a <> node").select("a", F.col("node").alias("b")).distinct(), folder, "alike")
    if not alike.isEmpty():
        others = own.where("node is not null").select("node").distinct().join(labels, F.col("node") == F.col("doc"), "left")
        labels = written(spark, others.select(F.col("node").alias("doc"), F.coalesce("comp", "node").alias("comp")), folder, "every-label")
        labels = merged_labels(spark, folder, "alike-merge", labels, alike)
    placed = own.where("doc is not null").join(labels.withColumnRenamed("doc", "node"), "node", "left")
    placed = placed.groupBy("doc").agg(F.min(F.coalesce("comp", "node", "doc")).alias("component"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = own.join(placed, "doc", "left").join(degree, "node", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    result = shared_dir(user)
    out.write.parquet(f"{result}/result")
    drop_dir(user, folder)
    return user.read.schema(out.schema).parquet(f"{result}/result")


def sketch_join_query(docs: DataFrame) -> DataFrame:
    return linked_components(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")
