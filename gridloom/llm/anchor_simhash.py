"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits. Two fingerprints link at ``distance`` (at most 4) or fewer differing
bits. The bits are dealt into six blocks, and a piece is three of them: for four differing bits, however
they fall into the blocks, one of the six pieces in ``_PIECES`` holds at most one of them (a test tries
every way). So it is enough to find, piece by piece, fingerprints that differ there in one bit at most.

In a piece, the first 31 bits are covered by the (31, 26) Hamming code: its codewords, with the piece's
other bits as they are, are the anchors, and every fingerprint has exactly one anchor within the covering
radius of 1, its home. Each fingerprint is sent to every anchor within radius plus one: its home, the 15
other codewords at distance two, and the home with one of the other bits turned. If two fingerprints
differ in at most one bit of the piece, the home of each is among the anchors of the other, so at every
anchor only fingerprints at home are compared with all that were sent there.

Copies go by their fingerprint from the start. At each anchor that more than one fingerprint reaches, the
others are compared with one hub at home there, and only what links becomes rows; it is contracted. Then
components are ranked by size and label: of two that link, the lesser has a fingerprint at home at an
anchor that the other reaches. So an anchor is left where no fingerprint at home is of lesser rank than the
highest there, and of the others' fingerprints only those at home below the highest, and those above the
lowest at home, become rows: each fingerprint once for each of its anchors at most, however many meet
there. These are compared in blocks of bounded size, each pair of blocks for itself, and a pair of blocks
gives a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_dir, merged_labels, own_session, shared_dir, slices, written

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: First bits of the six blocks, and the end. Any three blocks have 31 bits at least.
_CUTS = (0, 11, 22, 32, 43, 53, 64)
_PIECES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
_CODED = 31
#: Bit k of a syndrome is the parity of the positions (numbered from 1) that have bit k.
_CHECKS = [np.uint64(sum(1 << p - 1 for p in range(1, _CODED + 1) if p >> k & 1)) for k in range(5)]
#: For each syndrome the pairs of positions that cancel it, its own position left out.
_TWO = np.array([[(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, _CODED + 1) if i < i ^ s and i != s and i ^ s] for s in range(1, _CODED + 1)], dtype=np.uint64)
_PAIRS = 2_000_000
_EDGES = "a long, b long"


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text: bit k is set where more than half of its shingles' hashes have it.

    Words are parted by ASCII white space and A-Z are lower-cased; shingles are ``width`` words joined by
    one space, repeats counted; a shorter text is one shingle; a text without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(width, len(words))
    starts = np.concatenate([[0], ends[:len(words) - size]])
    joined = b" ".join(words)
    spans = map(slice, starts.tolist(), (ends[size - 1:] - 1).tolist())
    hashes = np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, spans), itertools.repeat(SEED)), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def anchors(prints: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of fingerprints (uint64) in one piece: the fingerprints' positions and the anchors' numbers.
    The first ``len(prints)`` anchors are the homes, in order."""
    bits, at = np.zeros(len(prints), dtype=np.uint64), 0
    for block in _PIECES[piece]:
        low, n = _CUTS[block], _CUTS[block + 1] - _CUTS[block]
        bits |= (prints >> np.uint64(low) & np.uint64((1 << n) - 1)) << np.uint64(at)
        at += n
    code = bits & np.uint64((1 << _CODED) - 1)
    syndrome = sum(((np.bitwise_count(code & check) & 1).astype(np.int64) << k for k, check in enumerate(_CHECKS)), np.zeros(len(prints), dtype=np.int64))
    off = np.flatnonzero(syndrome)  # codewords have no other codeword at distance two
    home = bits.copy()
    home[off] ^= np.uint64(1) << (syndrome[off] - 1).astype(np.uint64)
    two = bits[off, None] ^ _TWO[syndrome[off] - 1]
    free = home[:, None] ^ (np.uint64(1) << np.arange(_CODED, at, dtype=np.uint64))
    every = np.arange(len(prints))
    return (np.concatenate([every, np.repeat(off, two.shape[1]), np.repeat(every, free.shape[1])]),
            np.concatenate([home, two.ravel(), free.ravel()]) | np.uint64(piece << 40))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of (u, v) that connect what all of them connect, without a cycle."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two = at[:len(u)], at[len(u):]
    label, kept = np.arange(len(ids)), []
    where = np.arange(len(u))
    while True:
        x, y = label[one[where]], label[two[where]]
        still = x != y
        where, x, y = where[still], x[still], y[still]
        if not len(where):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]  # a root hangs below one smaller root
        kept.append(where[first])
        up = np.arange(len(ids))
        up[high[first]] = low[first]
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over
        label = up[label]
    some = np.concatenate([np.zeros(0, dtype=np.int64), *kept])
    return u[some], v[some]


def block_links(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the components (second arrays) that links between two lists of fingerprints (first arrays) join."""
    (own, own_comp), (others, other_comp) = left, right
    step, u, v = max(1, _PAIRS // max(1, len(others))), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for at in range(0, len(own), step):
        i, j = np.nonzero(np.bitwise_count(own[at:at + step, None] ^ others) <= distance)
        a, b = own_comp[at + i], other_comp[j]
        other = a != b
        u, v = forest(np.concatenate([u, a[other]]), np.concatenate([v, b[other]]))
    return u, v


def _printed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            prints = np.array([fingerprint(t, width) for t in some.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc": some.column(0), "print": pa.array(prints.view(np.int64))})

    return run


def _anchored(piece: int, more: int = 0):
    """Fingerprints at all their anchors, with ``more`` further columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 20_000):
            prints = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, keys = anchors(prints.view(np.uint64), piece)
            rest = {some.schema.names[k]: some.column(k).take(pa.array(at)) for k in range(1, 1 + more)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "print": pa.array(prints[at]), "home": pa.array(np.arange(len(at)) < len(prints))} | rest)

    return run


def _compared(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(column: pa.Array):
            flat, ends = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            prints, comps = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            return [(prints[a:b].view(np.uint64), comps[a:b]) for a, b in zip(ends[:-1], ends[1:])]

        for some in slices(batches, 1000):
            ends = [block_links(x, y, distance) for x, y in zip(lists(some.column(0)), lists(some.column(1)))]
            u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in zip(*ends)) if ends else (np.zeros(0, dtype=np.int64),) * 2
            u, v = forest(u, v)
            yield pa.RecordBatch.from_pydict({"a": pa.array(u), "b": pa.array(v)})

    return run


def _ends(spark, folder: str, name: str, links: DataFrame) -> DataFrame:
    """Labels to begin with: every end of a link is a component of its own."""
    ends = links.select(F.col("a").alias("doc")).unionByName(links.select(F.col("b").alias("doc"))).distinct()
    return written(spark, ends.select("doc", F.col("doc").alias("comp")), folder, name)


def _hub_links(spark, folder: str, nodes: DataFrame, distance: int) -> DataFrame:
    """a, b: links of fingerprints with one hub at home for each anchor that more than one reaches."""
    for piece in range(len(_PIECES)):  # one after another, so the shuffles of one piece are all that is on disk
        sent = nodes.select("print").mapInArrow(_anchored(piece), "key long, print long, home boolean")
        hub = F.min_by("print", F.when(F.col("home"), F.xxhash64("print")))
        hubs = sent.groupBy("key").agg(F.count("*").alias("c"), hub.alias("hub")).where("c > 1 and hub is not null").select("key", "hub")
        # Written first: a join that reads two plain exchanges is one whose hot keys Spark can split.
        hubs = written(spark, hubs, folder, f"hubs{piece}")
        near = sent.join(hubs, "key").where((F.col("print") != F.col("hub")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("hub"))) <= distance))
        near.select(F.least("print", "hub").alias("a"), F.greatest("print", "hub").alias("b")).write.parquet(f"{folder}/near/piece={piece}")
    near = spark.read.schema(_EDGES).parquet(*[f"{folder}/near/piece={piece}" for piece in range(len(_PIECES))])
    return written(spark, near.distinct(), folder, "links0")


def _open_members(spark, folder: str, weighed: DataFrame, block: int) -> DataFrame:
    """key, print, comp, lesser, higher, block: what anchors still have to compare. A pair of components that
    may link meets where a fingerprint of the one of lesser rank is at home (``lesser``), as ``higher``."""
    for piece in range(len(_PIECES)):
        sent = weighed.select("print", "comp", "size").mapInArrow(_anchored(piece, 2), "key long, print long, home boolean, comp long, size long")
        sent = sent.select("key", "print", "home", "comp", F.struct("size", "comp").alias("rank"))
        still = sent.groupBy("key").agg(F.max("rank").alias("top"), F.min(F.when(F.col("home"), F.col("rank"))).alias("low"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        still = written(spark, still.where("low < top"), folder, f"open{piece}")
        members = sent.join(still, "key").where("rank > low or home and rank < top")
        members.select("key", "print", "comp", F.expr("home and rank < top").alias("lesser"), F.expr("rank > low").alias("higher"),
                       F.pmod(F.xxhash64("print"), F.col("blocks")).alias("block")).write.parquet(f"{folder}/members/piece={piece}")
    return spark.read.schema("key long, print long, comp long, lesser boolean, higher boolean, block long").parquet(*[f"{folder}/members/piece={piece}" for piece in range(len(_PIECES))])


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    block: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hexadecimal digits) and component_id for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links of ``distance`` (0 to 4) or fewer differing bits.
    A null or empty text, or one without words, has fingerprint zero and links like any other. Rows with a
    null id link with nothing and have a null component. Rows that share an id are told apart by their
    fingerprints; repeated rows are alike. An empty table gives no rows. Columns of other names are ignored.
    ``block`` is the number of fingerprints of an anchor that one block holds, about.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distance is 0 to 4: the pieces cover no more differing bits")
    user, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    spark = own_session(user)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    printed = "doc long, print long"
    source.mapInArrow(_printed(width), printed).write.parquet(f"{folder}/own")
    own = spark.read.schema(printed).parquet(f"{folder}/own")
    nodes = written(spark, own.where("doc is not null").groupBy("print").agg(F.min("doc").alias("low")), folder, "nodes")

    links = _hub_links(spark, folder, nodes, distance)
    labels = merged_labels(spark, folder, "merge0", _ends(spark, folder, "ends0", links), links)
    comps = written(spark, nodes.join(labels, F.col("print") == F.col("doc"), "left").select("print", "low", F.coalesce("comp", "print").alias("comp")), folder, "comps")
    sizes = written(spark, comps.groupBy("comp").agg(F.count("*").alias("size")), folder, "sizes")
    weighed = written(spark, comps.join(sizes, "comp").select("print", "comp", "size"), folder, "weighed")

    members = _open_members(spark, folder, weighed, block)
    row = F.collect_list(F.struct("print", "comp"))  # about ``block`` members
    left = written(spark, members.where("lesser").groupBy("key", "block").agg(row.alias("x")).select("key", "x"), folder, "left")
    right = written(spark, members.where("higher").groupBy("key", "block").agg(row.alias("y")).select("key", "y"), folder, "right")
    links = written(spark, left.join(right, "key").select("x", "y").mapInArrow(_compared(distance), _EDGES).distinct(), folder, "links1")
    labels = merged_labels(spark, folder, "merge1", _ends(spark, folder, "ends1", links), links)

    joined = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("whole"))
    named = written(spark, comps.join(joined, "comp", "left").select("print", "low", F.coalesce("whole", "comp").alias("comp")), folder, "named")
    heads = written(spark, named.groupBy("comp").agg(F.min("low").alias("component")), folder, "heads")
    ends = written(spark, named.join(heads, "comp").select("print", "component"), folder, "ends")
    out = own.join(ends, "print", "left").select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"))
    result = shared_dir(user)
    out.write.parquet(f"{result}/result")
    drop_dir(user, folder)
    return user.read.schema(out.schema).parquet(f"{result}/result")


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
