"""The ten operators on small tables: odd rows, and equality with brute force, libraries or held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chunk_tokens, line_dedup, max_score, packing, pii_crf, piece_bpe, quality_cnn, quality_rules, sketch_join, token_store, toxicity_mil
from gridloom.llm.common import Recent, labelled_sample, shared_dir
from gridloom.llm.registry import BYTE_VOCABULARY, PIECE_MODEL, WORD_VOCABULARY, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "ids", "n", "doc", "own", "_own", "_gone", "gone", "pos", "line", "_words", "_lines", "_windows", "_place", "place", "head", "node", "mark", "comp", "words", "rank", "text2")
ODD_TEXTS = ["", " ", "\n\n", "a", "word " * 30000, "x" * 20000, "tab\tand\vodd\x1cgaps here !", "ΑΣ İ. ß ﬁ é 東京 𝒳 ▁ İ,", "the <|endoftext|> in <s> text</s>", "!!! ... ,,, $$$", "it's he'll 12,345.67"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents: empty, long, null text, null id, repeated rows, and a column with a clashing name."""
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(ODD_TEXTS)] + [(100, None, None, None, None), (None, "no id here", "en", None, 1), (7, ODD_TEXTS[7], "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({name: F.lit(1) for name in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts_of(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


# ---- 3, 4, 6: tokens -----------------------------------------------------------------------------


def fuzz(n=400):
    r = random.Random(3)
    parts = [" ", "  ", "   ", "a", "b", "the", "\n", "\t", "é", "▁", "東", "𝒳", "\x00", "\x1c", "\x85", "'s", "12", ".", ",", "!!", "aaaa", "<0xE2>", "<s>", "ß", "İ", "Σ", " the", "\r\n", "<|endoftext|>", "한", "ᄒ", "ᅡ"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)] + [" " * k for k in range(20)] + ["a" * k for k in range(20)] + ODD_TEXTS


def test_piece_encoding_equals_the_library():
    import sentencepiece

    mine, library = piece_bpe.PieceModel(vocabulary(PIECE_MODEL), cache=500), sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    texts = fuzz()
    for t, got in zip(texts, mine.encode(texts)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert mine.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("kind,name", [("byte", BYTE_VOCABULARY), ("word", WORD_VOCABULARY)])
def test_chunked_ids_equal_the_library(kind, name):
    from tokenizers import Tokenizer

    mine, library, texts = chunk_tokens.ChunkTokenizer(vocabulary(name), kind, cache=300), Tokenizer.from_file(vocabulary(name)), fuzz()
    for t, got in zip(texts, mine.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_recent_keeps_what_is_in_use():
    memory = Recent(2)
    for wanted in ({"a", "b", "c"}, {"c", "d"}, {"a", "d", "e"}, {"a"}):
        for w in memory.lacks(set(wanted)):
            memory.young[w] = w
        assert all(memory.young[w] == w for w in wanted)


def test_pieces_of_odd_rows(odd, none):
    import sentencepiece

    library, path = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL)), vocabulary(PIECE_MODEL)
    got = collections.Counter(tuple(r) for r in piece_bpe.pieces_query(odd, path).collect())
    want = collections.Counter()
    for (i, t), n in texts_of(odd).items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += n
    assert got == want
    assert piece_bpe.pieces_query(none, path).count() == 0


def test_dac_gives_every_token():
    r = np.random.default_rng(1)
    for ids in (np.array([5]), r.integers(0, 50000, 3000), r.integers(0, 2**32, 700, dtype=np.uint64), np.zeros(513, int), np.full(1025, 300)):
        reader = token_store.DacReader(token_store.dac_encode(ids.astype(np.uint32)))
        assert reader.tokens(0, len(ids)).tolist() == ids.tolist()
        for i in {0, len(ids) - 1, len(ids) // 2}:
            assert reader.token(i) == ids[i]
        a, b = len(ids) // 3, 2 * len(ids) // 3
        assert reader.tokens(a, b).tolist() == ids[a:b].tolist() and reader.tokens(a, a).tolist() == []


def test_token_store_of_odd_rows(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(vocabulary(WORD_VOCABULARY)), vocabulary(WORD_VOCABULARY)
    rows = token_store.token_store_query(spark, odd, path).collect()
    assert len(rows) == odd.count()
    crc = lambda t: zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in rows) == collections.Counter({(i, crc(t)): n for (i, t), n in texts_of(odd).items()})
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    token_store.write_tokens(odd, f"file://{tmp_path}/small", path, "word", 1, segment_tokens=50)
    again = token_store.read_tokens(spark, f"file://{tmp_path}/small")
    assert collections.Counter((r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in again.collect()) == collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in rows)
    assert token_store.token_store_query(spark, none, path).count() == 0


def test_packing_of_odd_rows(odd, none):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(vocabulary(BYTE_VOCABULARY)), vocabulary(BYTE_VOCABULARY)
    rows = packing.pack(odd, path).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert order == sorted(order, reverse=True)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == 4 * r.length for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for (i, t), n in texts_of(odd).items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r.start)[::n]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes() and all(r.doc_tokens == len(ids) for r in own)
        assert [r.length for r in own] == packing.piece_lengths(len(ids), 2048)
    assert packing.pack(none, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, path, max_len=1000)


# ---- 7, 8: near copies and lines -----------------------------------------------------------------


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
        sets[i] = frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[k:k + width]) for k in range(len(words) - width + 1)])
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(r, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width,percent,block", [(4, 85, 3), (5, 80, 1024)])
def test_sketch_join_equals_brute_force(spark, width, percent, block):
    r = random.Random(width)
    texts = []
    for size in (3, 6, 9, 14, 25, 60, 140, 400):
        base = [f"w{r.randrange(3000)}" for _ in range(size)]
        texts += family(r, base, 10, max(1, size // 60)) + [" ".join(base[:-1]), " ".join(base + ["Extra"]), " ".join(base).upper()]
    shared = " ".join(f"s{k}" for k in range(30))
    texts += [shared + " " + " ".join(f"u{k}_{j}" for j in range(20)) for k in range(25)]
    texts += ["", " ", None, "one", "one", "ONE two", "a b c d", "a b c d a b c d"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in sketch_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent, block=block).collect()}
    assert got == components(rows, width, percent)


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """1200 documents of one passage of 60 words and 12 of their own link with nothing. Their groups' pairs
    (hundreds of thousands) stay inside the block comparison; only pairs worth an exact check are rows."""
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, shared + " " + " ".join(f"u{i}_{k}" for k in range(12))) for i in range(1200)]
    made, write = {}, sketch_join.written

    def counted(session, frame, folder=None, name="t"):
        out = write(session, frame, folder, name)
        if name.startswith(("close", "members")):
            made[name] = out.count()
        return out

    monkeypatch.setattr(sketch_join, "written", counted)
    got = sketch_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert made["members"] > 1200 and sum(n for name, n in made.items() if name.startswith("close")) < 5 * 1200


def test_a_large_group_of_near_copies_makes_few_rows(spark, monkeypatch):
    """700 copies of one text with words changed, most of which link with most others."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(f"x{r.randrange(10**6)}" if r.random() < 0.02 else w for w in base)) for i in range(700)]
    made, write = {}, sketch_join.written

    def counted(session, frame, folder=None, name="t"):
        out = write(session, frame, folder, name)
        if name.startswith("close"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(sketch_join, "written", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in sketch_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == components(rows, 4, 85)
    assert sum(made.values()) < 20 * 700


def test_slices_hold_all_pairs():
    r = np.random.default_rng(4)
    left, right = r.integers(0, 9, 50), r.integers(0, 9, 50)
    want = [(a, b) for row in range(50) for a in range(left[:row].sum(), left[:row + 1].sum()) for b in range(right[:row].sum(), right[:row + 1].sum())]
    for most in (1, 7, 10**6):
        parts = list(sketch_join.pairs_in_slices(left, right, most))
        assert [(int(i), int(j)) for a, b in parts for i, j in zip(a, b)] == want and all(len(a) <= max(most, 8) for a, _ in parts)


def test_pigeonhole_never_loses_a_pair():
    r = np.random.default_rng(0)
    for n in (7, 8, 12, 20, 37, 75, 150, 500):
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(r.integers(0, max(1, int(0.07 * n)) + 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, int(0.07 * n)) + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common) and len(a) != common:
                shared = np.intersect1d(sketch_join._keys(a, 85), sketch_join._keys(b, 85))
                views = collections.Counter((shared & np.uint64(511)).tolist())
                assert any(count >= view >> 4 for view, count in views.items())


def test_sketch_join_of_odd_rows(odd, none):
    rows = sketch_join.linked_components(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[100].n_shingles == 0 and by[100].component_id == 100 and by[0].component_id == 0
    assert by[None].component_id is None and sum(r.doc_id == 7 for r in rows) == 2
    assert sketch_join.linked_components(none).count() == 0


def test_rows_of_one_id_are_one_component(spark):
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (3, "u v w x y z"), (9, "a b c d e f")]
    got = sketch_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {3}


def lines_gone(rows, least):
    count = lambda line: len([w for w in re.split(r"[\x20\x09-\x0D]+", line) if w])
    windows, lines = collections.defaultdict(set), {i: (t or "").split("\n") for i, t in rows}
    for i, own in lines.items():
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(map(count, own[a:b + 1])) >= least:
                    windows[tuple(own[a:b + 1])].add((i, a, b))
    gone = collections.defaultdict(set)
    for places in windows.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b + 1))
    return {i: sorted(gone[i]) for i in lines}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(f"w{r.randrange(99)}" for _ in range(r.randint(0, 6))) for _ in range(14)]
    rows = []
    for i in range(60):
        own = [r.choice(pool) if r.random() < 0.8 else f"unique {i} {k}" for k in range(r.randint(1, 14))]
        if i % 3 == 0:
            own += pool[2:9]
        if i % 7 == 0:
            own += [pool[5]] * 6
        rows.append((i, "\n".join(own)))
    rows += [(60, rows[0][1]), (61, None), (62, ""), (63, "\n\n\n"), (64, "\n\n\n")]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    want = lines_gone(rows, 10)
    for i, t in rows:
        assert list(got[i].removed_lines) == want[i]
        assert got[i].text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))
    assert sum(map(len, want.values())) > 100


def test_the_suffix_array_is_in_order_and_its_prefixes_are_right(spark):
    """Places of the array and common prefixes of neighbours, against sorted suffixes."""
    r = random.Random(21)
    spans = [[r.randrange(4) for _ in range(r.randint(1, 23))] for _ in range(25)] + [[1, 2, 3] * 5, [1, 2, 3] * 5, [2] * 9, [2] * 7]
    rows, own = [], {}
    for span in spans:
        first = len(rows) + 1
        for k, line in enumerate(span):
            own[first + k] = span[k:]
            rows.append((first + k, first + len(span) - 1, line))
    folder = shared_dir(spark)
    levels, suffixes = line_dedup.suffix_levels(spark, spark.createDataFrame(rows, "idx long, last long, rank long"), 30, folder)
    assert len(levels) == 6
    order = sorted(own, key=lambda i: (own[i], i))
    ranked = sorted((x["ranks"], x.idx) for x in suffixes.collect())
    assert [i for _, i in ranked] == order
    last = {i: end for i, end, _ in rows}
    array = spark.createDataFrame([(k + 1, i, last[i]) for k, i in enumerate(order)], "place long, idx long, last long")
    got = {x.place: x.lcp for x in line_dedup.common_prefixes(spark, array, levels, folder).collect()}

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert got == {k + 1: shared(own[order[k - 1]], own[order[k]]) for k in range(1, len(order))}


def test_line_dedup_of_odd_rows(spark, odd, none):
    out = line_dedup.line_dedup(odd).collect()
    assert len(out) == odd.count() and all(r[name] == 1 for r in out for name in CLASHES)
    assert line_dedup.line_dedup(none).count() == 0
    long = " ".join(f"w{k}" for k in range(60))
    same = [(1, long), (1, long), (2, "x\n" + long), (None, long)]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(same, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, ""), (1, ""), (2, "x"), (None, long)], key=str)


# ---- 1, 2, 5, 9: found and learnt ----------------------------------------------------------------


def test_base_spans_follow_the_patterns():
    text = "mail a.b+c@x-y.co.uk, 10.0.0.256 and 10.20.30.40; card 4111 1111 1111 1111 or 4111111111111112 call +1 (348) 555-6455 now"
    spans = [(k, text[a:b]) for k, a, b in pii_crf.base_spans(text)]
    assert spans == [(0, "a.b+c@x-y.co.uk"), (1, "10.20.30.40"), (2, "4111 1111 1111 1111"), (3, "+1 (348) 555-6455")]
    assert pii_crf.redacted("x 10.20.30.40 y", [(1, 2, 13)]) == "x [IP] y"
    assert pii_crf.redacted("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a[EMAIL]f"


@pytest.fixture(scope="module")
def crf():
    return pii_crf.trained()


PLAIN = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
         (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(pii_crf._digits(t)) <= 19 and pii_crf._luhn(pii_crf._digits(t))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(pii_crf._digits(t)) <= 15))


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(1)
    parts = ["a", "b9", "@", "@", ".", ".", "1", "12", "255", "256", "0", "+", "-", " ", "(", ")", "é", "%", "4111111111111111", "001."]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 24)))
        assert pii_crf.base_spans(text) == [(k, *m.span()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m.group())]


@pytest.mark.parametrize("text", ["0" * 10**6 + ".1.1.1", "a" * 10**6 + " x@", "1" * 10**6, "1." * 500_000, "@a" * 500_000, "a@" * 500_000, "+1 " * 300_000])
def test_long_runs_take_time_in_proportion(text):
    began = time.process_time()
    spans = pii_crf.base_spans(text)
    assert time.process_time() - began < 20
    assert spans[:1] == ([(1, 0, 10**6 + 6)] if text.startswith("00") else [(1, 0, 7)] if text.startswith("1.") else [])


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(4)
    emit, move, lengths = r.normal(size=(6, 5, 4)), r.normal(size=(4, 4)), np.array([5, 1, 3, 5, 2, 4])
    got = pii_crf.viterbi(emit, lengths, move)
    for k, n in enumerate(lengths):
        worth = lambda p: move[0, p[0]] + sum(emit[k, t, x] for t, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) + move[p[-1], 0]  # noqa: E731, B023
        assert tuple(got[k, :n]) == max(itertools.product(range(4), repeat=int(n)), key=worth)


def test_crf_gradient_equals_finite_differences():
    r = np.random.default_rng(4)
    weights, move = r.normal(size=(3, 7, 3)), r.normal(size=(3, 3))
    weights[:, -1] = 0
    given = [[[r.integers(0, 6) for _ in range(len(pii_crf.features("x")))] for _ in range(n)] for n in (4, 1, 6)]
    batch = pii_crf._padded(given, [r.integers(0, 3, len(g)).tolist() for g in given], 6)
    _, slope, slope_move = pii_crf.likelihood(weights, move, *batch)
    for value, g in ((weights[:, :-1], slope[:, :-1]), (move, slope_move)):
        for at in np.ndindex(value.shape):
            old, both = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                both.append(pii_crf.likelihood(weights, move, *batch)[0])
            value[at] = old
            assert abs((both[0] - both[1]) / 2e-5 - g[at]) < 1e-6


def test_crf_on_rows_kept_from_training():
    table = pii_crf.labelled_table()
    model = pii_crf.train([row for k, row in enumerate(table) if k % 5])
    kept = table[::5]
    right = told = truth = 0
    for (_, labels), got in zip(kept, pii_crf.Tagger(model).labels([tokens for tokens, _ in kept])):
        want, found = [pii_crf.LABELS.index(x) for x in labels], got.tolist()
        right += sum(a == b > 0 for a, b in zip(want, found))
        told, truth = told + sum(x > 0 for x in found), truth + sum(x > 0 for x in want)
    assert right / told > 0.97 and right / truth > 0.95


def test_secrets_come_from_the_field(spark, crf):
    text = 'Thst orti token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thhan with a plain token and key here'
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text[:14], "en", "s", 1)], SCHEMA)
    got = {x.doc_id: x for x in pii_crf.pii_query(docs).collect()}
    start = text.index("04d")
    assert got[1].spans == f"secret:{start}:{start + 40}" and (got[1].n_secret, got[1].n_spans, got[1].n_email) == (1, 1, 0)
    assert got[2].spans == "" and got[2].n_spans == 0


def test_crf_finds_what_patterns_miss(crf):
    tagger = pii_crf.Tagger(crf)
    right = total = 0
    table = pii_crf.labelled_table()[:200]
    for (_, want), got in zip(table, tagger.labels([t for t, _ in table])):
        right += sum(pii_crf.LABELS[g] == w for g, w in zip(got, want))
        total += len(want)
    assert right / total > 0.97
    text = "please call (348) 555-6455 or write bob.x at example dot com soon"
    (base, spans), = pii_crf.all_spans([text], tagger)
    assert base == [] and {pii_crf.KINDS[k] for k, _, _ in spans} == {"email", "phone"}


def test_cut_chains_decode_like_whole_ones(crf):
    tagger = pii_crf.Tagger(crf)
    table = pii_crf.labelled_table()[:60]
    cut = tagger.labels([t for t, _ in table])
    tagger.gain = tagger.gain + 1e9
    assert all((a == b).all() for a, b in zip(cut, tagger.labels([t for t, _ in table])))


def test_pii_of_odd_rows(odd, none, crf):
    assert pii_crf.find_pii(odd, crf).count() == odd.count()
    kept = pii_crf.redact(odd, crf)
    assert kept.columns == odd.columns and texts_of(kept) == texts_of(odd)
    assert pii_crf.find_pii(none, crf).count() == 0 and pii_crf.redact(none, crf).count() == 0
    row = pii_crf.pii_query(odd.where("doc_id = 100")).first()
    assert row.spans == "" and row.base_sha256 == hashlib.sha256(b"").hexdigest() and row.n_email == row.n_card == 0


def planted(n=300, seed=2):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    docs, toxic = [], []
    for i in range(n):
        bad = i % 4 == 0
        own = [[r.choice(words) for _ in range(r.randint(3, 9))] for _ in range(r.randint(1, 15))]
        if bad:
            r.choice(own).append(r.choice(("grolk", "snarfed")))
        docs.append(". ".join(" ".join(s) for s in own) + ".")
        toxic.append(int(bad))
    return docs, np.array(toxic)


def test_mil_learns_and_locates():
    docs, toxic = planted()
    model = toxicity_mil.train(docs, toxic)
    fresh, truth = planted(seed=7)
    weights = toxicity_mil.word_weights(model.weights)
    got = [toxicity_mil.scored(t, model.bias, weights) for t in fresh]
    assert np.mean([(s >= 0.5) == y for (s, _), y in zip(got, truth)]) > 0.98
    for t, (s, where), y in zip(fresh, got, truth):
        if y and s >= 0.5:
            a, b = map(int, where.split(",")[0].split(":"))
            assert re.search("grolk|snarfed", t[a:b])


def test_noisy_or_gradient_equals_finite_differences():
    r = np.random.default_rng(7)
    words, starts, bag = r.integers(0, 6, 30), np.array([0, 4, 4, 9, 15, 22]), np.array([0, 0, 1, 1, 2, 3])
    y, weights, bias = np.array([1, 0, 1, 0]), r.normal(size=6), -0.7
    _, slope, slope_bias = toxicity_mil.gradients(words, starts, bag, y, weights, bias)
    for k in range(6):
        both = []
        for step in (1e-6, -1e-6):
            moved = weights.copy()
            moved[k] += step
            both.append(toxicity_mil.gradients(words, starts, bag, y, moved, bias)[0])
        assert abs((both[0] - both[1]) / 2e-6 - slope[k]) < 1e-7
    both = [toxicity_mil.gradients(words, starts, bag, y, weights, bias + step)[0] for step in (1e-6, -1e-6)]
    assert abs((both[0] - both[1]) / 2e-6 - slope_bias) < 1e-7


def test_one_label_alone_gives_a_constant():
    assert toxicity_mil.train(["a b"], np.array([0])).weights == {} and toxicity_mil.train([], np.array([])).bias < 0
    assert quality_cnn.probabilities([b"abc", b""], quality_cnn.train([b"x"], np.array([1]))).shape == (2,)


def test_scores_of_odd_rows(odd, none):
    docs, toxic = planted(80)
    mil = toxicity_mil.train(docs, toxic)
    rows = toxicity_mil.score(odd, mil).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    cnn = quality_cnn.train([d.encode() for d in docs], toxic, epochs=1)
    rows = quality_cnn.score(odd, cnn).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_mil.score(none, mil).count() == 0 and quality_cnn.score(none, cnn).count() == 0


def test_cnn_learns_bytes_and_reads_long_texts_whole(monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(r.randint(5, 90))) for _ in range(150)]
    bad = [" | ".join(word() for _ in range(r.randint(5, 90))) for _ in range(75)] + ["% ".join([word()] * r.randint(6, 60)) for _ in range(75)]
    texts, y = [t.encode() for t in good + bad], np.array([1] * 150 + [0] * 150)
    model = quality_cnn.train(texts, y, epochs=6, least_steps=60)
    assert ((quality_cnn.probabilities(texts, model) >= 0.5) == y).mean() > 0.95
    # A score is the text's own: the same bits alone, in any company, and in any stretches.
    some = [b"", b"x", b"xxxx", b"x" * 30, *texts[:20], b" ".join(texts)]
    alone = [quality_cnn.probabilities([t], model)[0] for t in some]
    assert (quality_cnn.probabilities(some, model) == alone).all()
    assert (quality_cnn.probabilities(some[::-1], model) == alone[::-1]).all()
    monkeypatch.setattr(quality_cnn, "_STEP_BYTES", 4096)
    assert (quality_cnn.probabilities(some, model) == alone).all()


def test_cnn_gradients_equal_finite_differences():
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 105, n, dtype=np.uint8)) for n in (3, 40, 90, 17)]
    y = np.array([1, 0, 1, 0])
    model = quality_cnn.CnnModel(r.normal(size=(3, 256, 4)), r.normal(size=4), r.normal(size=8), 0.3, 16)
    _, slope = quality_cnn.gradients(texts, y, model)
    for name in ("table", "bias", "unit"):
        value = getattr(model, name)
        places = np.flatnonzero(np.abs(slope[name]).ravel() > 1e-4)[:25]
        assert len(places)
        for at in places:
            old, losses = value.flat[at], []
            for step in (1e-6, -1e-6):
                value.flat[at] = old + step
                losses.append(quality_cnn.gradients(texts, y, model)[0])
            value.flat[at] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - slope[name].flat[at]) < 1e-5


def test_scores_of_all_queries_keep_their_contract(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) if i % 3 else " | ".join(["zz"] * 60) for i in range(120)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    for query, level in ((quality_cnn.quality_query, 0.3), (toxicity_mil.toxicity_query, 0.5)):
        got = query(docs, labels).collect()
        assert len(got) == 121
        for x in got:
            assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
            assert 0 <= x.score <= 1 and x.predicted == int(x.score >= level)
        assert query(docs.where("false"), labels).count() == 0
        assert query(docs, labels.where("false")).count() == 121
    kept = quality_rules.quality_rules_query(docs, labels)
    assert kept.count() == 121 and quality_rules.quality_rules_query(docs.where("false"), labels.where("false")).count() == 0


def rule_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    times = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_equal_brute_force(spark, odd, none):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(k)}" for _ in range(r.randint(0, 200))) for k in (2, 3, 5, 20, 400) for _ in range(8)] + ["a\nb\na\n \nb", "# $ | < >", "x y z x y z", "a b c d e f " * 80]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for x in quality_rules.quality_rules(frame, []).collect():
        want = rule_counts(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and x.kept == (not x.base_failed)
    assert quality_rules.quality_rules(none, []).count() == 0 and quality_rules.quality_rules(odd, []).count() == odd.count()


def test_decision_lists_cover_and_apply(spark):
    r = np.random.default_rng(3)
    rows = r.random((600, len(quality_rules.FEATURES)))
    bad = (rows[:, 0] > 0.8) | (rows[:, 1] > 0.7) & (rows[:, 4] <= 0.4)
    rules = quality_rules.learn_rules(rows, bad)
    caught = np.any([quality_rules._covers(rule, rows, quality_rules.FEATURES) for rule in rules], axis=0)
    assert (caught == bad).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(float, x)) for x in rows], ", ".join(f"{n} double" for n in quality_rules.FEATURES))
    got = np.array([x[0] > 0 for x in frame.select(quality_rules.verdict(rules)).collect()])
    assert (got == caught).all()
    assert quality_rules.learn_rules(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0, bool)) == []


def test_the_sample_is_bounded_and_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x", "y", 1) for i in range(200)] + [(5, None, "x", "y", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 220)] + [(None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(docs, labels, "quality", 50, 100).collect()
    assert 0 < len(rows) <= 50 and all(zlib.crc32(str(r.key).encode()) % 5 for r in rows)
    assert labelled_sample(docs, labels.where("false"), "quality", 50, 100).count() == 0


# ---- 10: search ----------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in np.round(r.normal(size=12), 1)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 10), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (None, [1.0] * 12), (20, rows[20][1]), (31, rows[31][1]), (405, rows[0][1][:6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    vectors = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((i, np.floor(64 * np.array(v + [0.0] * (12 - len(v)))).astype(int)))
    own = max_score.integer_vectors(frame)
    got = collections.defaultdict(list)
    for x in max_score.top_k(own, own.where("vec_id % 20 = 0"), 20, shard_rows=90, block_rows=8).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    asked = {i: v for i, v in vectors if i % 20 == 0}
    assert set(got) == set(asked)
    for q, found in got.items():
        best = sorted((-int(asked[q] @ v), i) for i, v in vectors if i != q)[:20]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert max_score.top_k_query(frame.where("vec_id in (0, 1, 2)")).count() == 2
    assert max_score.top_k_query(frame.where("false")).count() == 0


def test_max_score_skips_postings_as_the_bar_rises():
    r = np.random.default_rng(5)
    vectors = np.floor(r.normal(size=(4000, 32)) * 2.0 ** -np.arange(32) * 4096).astype(np.int64)
    ids = np.arange(4000)
    places, scores, read = max_score.cell_top_k(ids[:40], vectors[:40], ids, vectors, 10)
    for q in range(40):
        best = sorted((-int(vectors[q] @ v), i) for i, v in zip(ids.tolist(), vectors) if i != q)[:10]
        assert [(-int(s), int(i)) for i, s in zip(places[q], scores[q])] == best
    assert read < 0.4 * 40 * vectors.size
    bars = max_score.sample_bars(ids[:40], vectors[:40], ids[::4], vectors[::4], 10)
    again, same, fewer = max_score.cell_top_k(ids[:40], vectors[:40], ids, vectors, 10, bars)
    assert all((a == b).all() for a, b in zip(scores, same)) and fewer < 0.75 * read


def test_max_score_with_bars_from_a_sample():
    """Ties at the bar, repeated vectors, few candidates, and numbers too large for doubles."""
    r = np.random.default_rng(6)
    for scale, n in ((3, 300), (3, 12), (2**29, 200)):
        vectors = r.integers(-scale, scale, (n, 8))
        vectors[5:9] = vectors[3]
        ids = np.sort(r.choice(10 * n, n, replace=False))
        asked = np.arange(0, n, 3)
        for sample in (np.arange(n), np.arange(0, n, 2), np.arange(5)):
            bars = max_score.sample_bars(ids[asked], vectors[asked], ids[sample], vectors[sample], 10)
            places, scores, _ = max_score.cell_top_k(ids[asked], vectors[asked], ids, vectors, 10, bars)
            for q, p, s in zip(asked, places, scores):
                best = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], v)), int(i)) for i, v in zip(ids, vectors) if i != ids[q])[:10]
                assert [(-int(x), int(ids[i])) for i, x in zip(p, s)] == best


def test_struct_is_little_endian():
    assert struct.pack("<I", 1) == b"\x01\0\0\0"
