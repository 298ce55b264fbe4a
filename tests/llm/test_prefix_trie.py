"""The prefix trie against a plain trie, with odd, repeated, long and hot conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm.common import running, shared_dir
from gridloom.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows, shared_heads):
    """Every node, by walking all ancestors of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, first = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = [*own.get(first, [])[:h], *turns[h:]] if shared_heads else turns
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items()), key=str)


def got_trie(frame, shared_heads):
    return sorted((tuple(r) for r in prefix_trie(frame, shared_heads).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(seed=3, n=160):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 700), n):
        for turn in range(r.choice((1, 2, 2, 3, 5, 9))):
            rows.append((c, turn if r.random() < 0.9 else None, r.choice(("user", "assistant", None, "")), r.choice(("a", "b", "ab", "", None, "é𝒳", "x" * 50))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shared_heads", [True, False])
def test_nodes_equal_a_plain_trie(spark, shared_heads):
    rows = conversations()
    rows += [*rows[:20], (None, 0, "user", "lost"), (None, None, None, None)]  # repeated turns, and turns of no conversation
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "pos", "a", "b", "n", "h", "depth", "n_convs", "range", "number")})
    assert got_trie(frame, shared_heads) == plain_trie(rows, shared_heads)


def test_a_hundred_without_its_first_and_turnless_conversations(spark):
    few = [c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "user", "gone") for c in few] + [(305, t, "user", str(t)) for t in range(8)]
    got = got_trie(spark.createDataFrame(rows, SCHEMA), True)
    assert got == plain_trie(rows, True)
    root, = [r for r in got if r[1] == 0]
    assert root[0] == few[0] and root[7] == hashlib.sha256(",".join(map(str, few)).encode()).hexdigest()


def test_one_conversation_holds_most_rows(spark):
    """A conversation of 700 turns, deeper than any fixed number of rounds, and 300 copies of one conversation."""
    rows = [(5, t, "user", str(t % 7)) for t in range(700)] + [(1000 + c, t, "user", "same") for c in range(300) for t in range(2)]
    assert got_trie(spark.createDataFrame(rows, SCHEMA), False) == plain_trie(rows, False)


def test_no_conversations(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie(frame, True).count() == 0 and prefix_trie(frame.where("false")).count() == 0


def test_running_totals_cross_ranges(spark):
    rows = [("one", i, i * i % 11) for i in range(500)] + [("two", 3, 4)] * 40 + [(f"g{i}", 0, 1) for i in range(30)]
    frame = spark.createDataFrame(rows, "g string, o long, v long").repartition(6)
    out = running(spark, frame, ["g"], ["o"], {"s": ("sum", "v"), "x": ("xor", "v")}, shared_dir(spark), "t").collect()
    sums, xors = defaultdict(list), defaultdict(list)
    for g, _, v in sorted(rows):
        sums[g].append((sums[g] or [0])[-1] + v)
        xors[g].append((xors[g] or [0])[-1] ^ v)
    for g in sums:
        assert sorted(r.s for r in out if r.g == g) == sums[g]
        assert sorted(r.x for r in out if r.g == g) == sorted(xors[g])
    alone = running(spark, frame, [], ["g", "o"], {"s": ("sum", "v")}, shared_dir(spark), "t")
    assert sorted(r.s for r in alone.collect())[-1] == sum(r[2] for r in rows)
