"""Prefix trie of conversations by pointer jumping.

Every distinct sequence of first turns is a node. A node goes by a 120-bit digest: the XOR of a hash of
each turn with its place, so the digests of all prefixes of a conversation are a running total, and a
conversation of any length is spread over tasks. A turn's own digest is taken off to get the parent's.

What a subtree holds (childless nodes, savings) is gathered by doubling: every node holds the totals of
its descendants at less than 2**k steps and points to its ancestor at 2**k steps. In a round each node
gives its totals to the ancestor that it points to, then takes over that ancestor's pointer. After as
many rounds as the greatest depth has binary digits every ancestor has everything, however deep the trie.

The members that end at a node enter a SHA-256 in ascending order. Their ids are sorted by ranges, made
into runs of text in parallel, and only the digest itself, which is a chain by definition, goes through
a node's runs one by one, holding one run at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop_dir, own_session, running, shared_dir, written

_KEY = ["a", "b"]
_RUN = 4096


def ordered_turns(spark: SparkSession, conversations: DataFrame, folder: str, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, pos (from 1), t1 and t2 (digest of role and text), chars. Rows without a conversation go."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.length(text).cast("long").alias("chars"), digest.alias("t"))
    turns = turns.where("conv is not null").select("conv", "turn", "t", "chars", F.lit(1).cast("long").alias("one"))
    placed = running(spark, turns, ["conv"], ["turn", "t"], {"pos": ("sum", "one")}, folder, "ordered")
    part = lambda at: F.conv(F.substring("t", at, 15), 16, 10).cast("long")
    return written(spark, placed.select("conv", "pos", part(1).alias("t1"), part(16).alias("t2"), "chars"), folder, "turns")


def _heads() -> F.Column:
    return F.crc32(F.col("conv").cast("string").cast("binary")) % 6


def with_shared_heads(spark: SparkSession, turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the conversation that their hundred begins with: of
    conversation c the first h turns of c - c % 100 (all if fewer), then c's own after its first h, with
    h = crc32(decimal c) % 6. Returns turns (with ``total`` turns of the conversation) and conv, total."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": _heads(), "first": F.col("conv") - F.col("conv") % 100})
    own = written(spark, own, folder, "own")
    firsts = own.where("conv % 100 = 0").select(F.col("conv").alias("first"), F.col("n").alias("there"))
    members = own.join(firsts, "first", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    members = members.select("conv", "first", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    members = written(spark, members, folder, "members")
    # At most five turns of a first conversation, for at most 199 others.
    given = turns.where("conv % 100 = 0 and pos <= 5").withColumnRenamed("conv", "first")
    heads = members.where("taken > 0").join(given, "first").where("pos <= taken").select("conv", "pos", "t1", "t2", "chars", "total")
    tails = turns.where(F.col("pos") > _heads()).join(members, "conv").select("conv", (F.col("taken") + F.col("pos") - _heads()).alias("pos"), "t1", "t2", "chars", "total")
    return heads.unionByName(tails), members.select("conv", "total")


def _ids_in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv) to runs of at most ``_RUN`` ids of one node: a, b, first, ids as text."""
    for batch in batches:
        a, b, conv = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        if not len(a):
            continue
        new = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]])
        at = np.concatenate([np.arange(x, y, _RUN) for x, y in zip(new[:-1], new[1:])])
        texts = [",".join(map(str, conv[x:y].tolist())).encode() for x, y in zip(at, [*at[1:], len(a)])]
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[at]), "b": pa.array(b[at]), "first": pa.array(conv[at]), "ids": pa.array(texts, pa.binary())})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (a, b, first) to one SHA-256 a node; a node may go on in the next batch."""
    here, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([here[0]], pa.int64()), "b": pa.array([here[1]], pa.int64()), "ends_sha256": pa.array([state.hexdigest()])})

    for batch in batches:
        out = []
        for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if here == (a, b):
                state.update(b"," + ids)
                continue
            if here is not None:
                out.append(row())
            here, state = (a, b), hashlib.sha256(ids)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if here is not None:
        yield row()


def _subtrees(spark: SparkSession, nodes: DataFrame, deepest: int, values: list[str], folder: str) -> DataFrame:
    """a, b and ``values`` summed over each node's subtree. ``nodes`` has a, b, pa, pb and the values."""
    state, rounds = nodes.select(*_KEY, F.col("pa").alias("ua"), F.col("pb").alias("ub"), *values), deepest.bit_length()
    for k in range(rounds):
        moving = state.where("ua is not null")
        given = moving.groupBy("ua", "ub").agg(*[F.sum(v).alias(f"more_{v}") for v in values]).withColumnsRenamed({"ua": "a", "ub": "b"})
        summed = state.join(given, _KEY, "left").select(*_KEY, "ua", "ub", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        summed = written(spark, summed, folder, f"summed{k}")
        if k + 1 < rounds:
            # Pointers past the root are null, more of them in each round; they stay out of the join.
            over = state.select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("ua").alias("na"), F.col("ub").alias("nb"))
            jumped = summed.where("ua is not null").join(over, ["ua", "ub"]).select(*_KEY, F.col("na").alias("ua"), F.col("nb").alias("ub"), *values)
            summed = written(spark, jumped.unionByName(summed.where("ua is null")), folder, f"jumped{k}")
            drop_dir(spark, f"{folder}/summed{k}")
        state = summed
    return state.select(*_KEY, *values)


def trie(spark: SparkSession, turns: DataFrame, members: DataFrame, folder: str) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos from 1 without gaps, t1, t2, chars, total turns of the
    conversation); ``members`` (conv, total) has the conversations without turns too."""
    hashed = turns.withColumns({"e1": F.xxhash64("pos", "t1", "t2"), "e2": F.xxhash64(F.lit(7), "t2", "t1", "pos")})
    along = running(spark, hashed, ["conv"], ["pos"], {"a": ("xor", "e1"), "b": ("xor", "e2")}, folder, "hashed")
    along = along.select("conv", F.col("pos").cast("long").alias("depth"), *_KEY, F.col("a").bitwiseXOR(F.col("e1")).alias("pa"), F.col("b").bitwiseXOR(F.col("e2")).alias("pb"), "chars", (F.col("pos") == F.col("total")).alias("last"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = members.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("chars"), (F.col("total") == 0).alias("last"))
    prefixes = written(spark, along.unionByName(roots), folder, "prefixes")
    nodes = prefixes.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = written(spark, nodes, folder, "nodes")
    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = written(spark, nodes, folder, "counted")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = _subtrees(spark, nodes, deepest, ["n_leaves", "saved_tokens"], folder)

    ends = prefixes.where("last").select(*_KEY, "conv")
    runs = ends.repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(_ids_in_runs, "a long, b long, first long, ids binary")
    ends = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digested, "a long, b long, ends_sha256 string")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    named = written(spark, nodes.drop("n_leaves", "saved_tokens").join(parents, ["pa", "pb"], "left"), folder, "named")
    return named.join(sums, _KEY).join(written(spark, ends, folder, "ends"), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, shared_heads: bool = False, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes of the prefix trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node's (conv_id, depth) names its turns. ``saved_tokens`` counts code points of last texts that the
    other members need not store; ``ends_sha256`` is the SHA-256 of the ids of members that end there.
    Turns stand in the order of ``turn`` (null first); equal turns in the order of the SHA-256 of role
    and text; repeated rows are turns of their own. Null roles and texts are empty. Rows with a null
    conversation id take no part. An empty table gives no nodes. Columns of other names are ignored.
    ``shared_heads`` first gives conversations the heads described at ``with_shared_heads``; a
    conversation may be left without turns and is then a member of the root alone.
    """
    user, folder = conversations.sparkSession, shared_dir(conversations.sparkSession)
    spark = own_session(user)
    turns = ordered_turns(spark, conversations, folder, id_col, turn_col, role_col, text_col)
    if shared_heads:
        turns, members = with_shared_heads(spark, turns, folder)
    else:
        members = written(spark, turns.groupBy("conv").agg(F.count("*").alias("total")), folder, "members")
        turns = turns.join(members, "conv")
    out = trie(spark, turns, members, folder)
    result = shared_dir(user)
    out.write.parquet(f"{result}/result")
    drop_dir(user, folder)
    return user.read.schema(out.schema).parquet(f"{result}/result")


def trie_query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations, shared_heads=True)
