"""SimHash near-duplicates: fingerprints and components against brute force, the covering, blocks and odd rows."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import anchor_simhash as simhash


def plain_fingerprint(text, width=4):
    """Bit by bit, as stated."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\v\f\r":
        lowered = lowered.replace(gap, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance):
    """Smallest id reachable, by comparing all with all."""
    best = list(ids)
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (prints[i] ^ prints[j]).bit_count() <= distance]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            if best[i] != low or best[j] != low:
                best[i] = best[j] = low
                changed = True
    return best


def copies(seed=5, families=12, each=14):
    """Texts of families of near copies, with words changed, added at the end and dropped."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    out = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(30, 250))]
        for _ in range(each):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own if r.random() < 0.7 else own[:-r.randint(1, 8)]).upper() if r.random() < 0.2 else "\t".join(own))
    return out


def test_pieces_cover_every_way_to_differ():
    def ways(blocks, left):
        if blocks == 1:
            yield (left,)
        else:
            for k in range(left + 1):
                for rest in ways(blocks - 1, left - k):
                    yield (k, *rest)

    for bits in range(5):
        assert all(any(sum(way[b] for b in piece) <= 1 for piece in simhash._PIECES) for way in ways(6, bits))


def test_close_fingerprints_meet_at_both_homes():
    r = random.Random(1)
    for bits in (0, 1, 2, 3, 4):
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for k in r.sample(range(64), bits):
                y ^= 1 << k
            met = set()
            for piece in range(len(simhash._PIECES)):
                at, keys = simhash.anchors(np.array([x, y], dtype=np.uint64), piece)
                sent = [set(keys[at == k].tolist()) for k in (0, 1)]
                assert all(len(s) == (at == k).sum() for k, s in enumerate(sent))  # no anchor twice
                met |= {k for k in (0, 1) if int(keys[k]) in sent[1 - k]}
            assert met == {0, 1}


def test_forest_connects_the_same():
    r = np.random.default_rng(2)
    for n, m in ((1, 0), (5, 8), (60, 40), (200, 5000)):
        u, v = r.integers(0, n, m) * 7, r.integers(0, n, m) * 7
        a, b = simhash.forest(u, v)
        own = plain_components(range(0, 7 * n, 7), range(n), -1)

        def joined(x, y):
            best = dict(zip(range(0, 7 * n, 7), own))
            for _ in range(n):
                for i, j in zip(x.tolist(), y.tolist()):
                    best[i] = best[j] = min(best[i], best[j])
            return best

        assert joined(u, v) == joined(a, b) and len(a) == n - len(set(joined(u, v).values()))


def test_blocks_give_a_forest_of_all_links():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 3, dtype=np.uint64)
    one = np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for b in base])
    comp = np.arange(len(one)) * 10
    u, v = simhash.block_links((one, comp), (one, comp), 4)
    want = plain_components(comp.tolist(), [int(x) for x in one], 4)
    best = dict(zip(comp.tolist(), comp.tolist()))
    for _ in range(len(one)):
        for i, j in zip(u.tolist(), v.tolist()):
            best[i] = best[j] = min(best[i], best[j])
    assert list(best.values()) == want and len(u) == len(one) - len(set(want))


@pytest.mark.parametrize(("distance", "block"), [(4, 4096), (4, 3), (1, 4096), (0, 5)])
def test_components_equal_brute_force(spark, distance, block):
    texts = [*copies(), *copies(6, 3, 30), "", None, " \n", "one", "ONE", "one two three", "é ü 東京 𝒳 x"]
    ids = [(37 * i + 11) % 1009 for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame, distance=distance, block=block).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = dict(zip(ids, zip([f"{p:016x}" for p in prints], plain_components(ids, prints, distance))))
    assert got == want
    assert distance == 0 or len({c for _, c in got.values()}) < len({p for p, _ in got.values()})


def test_a_large_group_of_near_copies(spark):
    """2000 different fingerprints around one, whose links make one component, and others just out of reach."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    turned = {centre}
    while len(turned) < 2000:
        x = centre
        for k in r.sample(range(64), r.randint(1, 7)):
            x ^= 1 << k
        turned.add(x)
    prints = sorted(turned)
    frame = spark.createDataFrame([(i,) for i in range(len(prints))], "doc_id long").withColumn("text", F.col("doc_id").cast("string"))
    held, simhash.fingerprint = simhash.fingerprint, lambda text, width=4, prints=prints: prints[int(text)]
    try:
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame, block=200).collect()}
    finally:
        simhash.fingerprint = held
    assert [got[i] for i in range(len(prints))] == plain_components(range(len(prints)), prints, 4)


def rows_joined_by_anchor(spark, since=-1):
    """Rows that joins by ``key`` made in executions after number ``since``, and the last number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, made, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for number in (runs.apply(i).executionId() for i in range(runs.size())):
        if number <= since:
            continue
        last, values, nodes = max(last, number), store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join [key#" in node.desc():
                rows = [m for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                made += sum(int(values.get(m.accumulatorId()).get().replace(",", "")) for m in rows if values.get(m.accumulatorId()).isDefined())
    return made, last


def test_near_copies_that_seldom_link_make_few_rows(spark):
    """1500 fingerprints five to nine bits from one: they meet at many anchors, most of them link with nothing."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    turned = set()
    while len(turned) < 1500:
        x = centre
        for k in r.sample(range(64), r.randint(5, 9)):
            x ^= 1 << k
        turned.add(x)
    prints = sorted(turned)
    frame = spark.createDataFrame([(i,) for i in range(len(prints))], "doc_id long").withColumn("text", F.col("doc_id").cast("string"))
    held, simhash.fingerprint = simhash.fingerprint, lambda text, width=4, prints=prints: prints[int(text)]
    _, since = rows_joined_by_anchor(spark)
    try:
        got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame).collect()}
    finally:
        simhash.fingerprint = held
    want = plain_components(range(len(prints)), prints, 4)
    assert [got[i] for i in range(len(prints))] == want and len(set(want)) > 1000
    made, _ = rows_joined_by_anchor(spark, since)
    assert 1500 < made < 30 * 1500


def test_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "something else entirely here now"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (7, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "print", "key", "home", "comp", "low", "fingerprint", "component_id")})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    a, b = f"{plain_fingerprint('a b c d e'):016x}", f"{plain_fingerprint('something else entirely here now'):016x}"
    assert got == sorted([(1, a, 1), (1, b, 1), (1, a, 1), (None, a, None), (None, "0" * 16, None), (7, "0" * 16, 3), (3, "0" * 16, 3)], key=str)
    assert simhash.near_duplicates(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(frame, distance=5)


def test_long_texts():
    text = " ".join(str(i % 5000) for i in range(300_000))
    assert simhash.fingerprint(text[:20_000]) == plain_fingerprint(text[:20_000])
    assert simhash.fingerprint(text) == plain_fingerprint(text)
