"""The pipeline's stages on a small corpus against brute force, and the registered queries against their SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from test_operators import components, lines_gone, rule_counts

from gridloom.llm import quality_rules, registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    base = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "conversations"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SMALL)
        want = base.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))


def test_stages_take_effect(spark):
    from gridloom.llm.common import table

    docs = table(spark, SMALL, "documents").cache()
    columns, frame = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SMALL).cache()
        assert out.columns == columns, name
        before, after = {r.doc_id for r in frame.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name in ("line dedup", "pii"):
            assert after == before
        frame = out
    assert frame.count() < docs.count()
    assert not [r.doc_id for r in frame.collect() if re.search(r"[a-z]@mail\d\.example\.com", r.text)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in frame.collect()}


def features(text):
    """What rules may ask, by hand."""
    n, chars, symbols, dup, repeat = rule_counts(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    share = lambda a, b: a / b if b else 0.0
    return (share(symbols, chars), share(repeat, n), share(dup, len(lines)), share(chars, n), share(sum(c.isupper() for c in text), chars), share(text.count("|"), chars),
            share(text.count("!"), chars), share(sum(c in "0123456789" for c in text), chars), share(sum(bool(re.search(r"[.!?][\x20\x09-\x0D]*$", x)) for x in lines), len(lines)),
            share(len(set(words)), n), share(n, len(lines)))


def test_stages_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    line = lambda mark="": " ".join(word() + mark for _ in range(r.randint(9, 15))) + "."
    passage = [line() for _ in range(7)]
    texts = []
    for k in range(90):
        own = [line(" |" if k % 4 == 0 else "") for _ in range(r.randint(6, 9))]
        if k % 5 == 1:
            at = r.randint(0, len(own))
            own = own[:at] + passage[r.randint(0, 1):] + own[at:]
        if k % 7 == 2:
            own[0] += f" write to {word()}.{k}@mail.example.com now"
        texts.append("\n".join(own))
    texts += [texts[3].replace("\n", " ") + " more", texts[6].replace("\n", " "), texts[9], "too short", "", None, "a b c " * 40]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    rules = quality_rules.learnt(docs, labels)
    assert rules
    stage = dict(corpus_pipeline.STAGES)

    def kept(text):
        n, _, _, _, repeat = rule_counts(text)
        found = np.array([features(text or "")])
        return n >= 50 and 100 * repeat <= 50 * n and not any(quality_rules._covers(rule, found, quality_rules.FEATURES)[0] for rule in rules)

    now = stage["quality rules"](spark, docs, str(tmp_path)).cache()
    want = {i: t for i, t in enumerate(texts) if kept(t)}
    assert {x.doc_id: x.text for x in now.collect()} == want and 40 < len(want) < 75
    now = stage["line dedup"](spark, now, str(tmp_path)).cache()
    gone = lines_gone(sorted(want.items()), 50)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in want.items()}
    got = now.collect()
    assert {x.doc_id: x.text for x in got} == want and any(gone.values()) and all(x.n_chars == len(x.text) for x in got)
    now = stage["near duplicates"](spark, now, str(tmp_path)).cache()
    head = components(sorted(want.items()), 5, 80)
    kept_ids = {i for i in want if head[i][1] == i}
    assert {x.doc_id for x in now.collect()} == kept_ids and len(kept_ids) < len(want)
    now = stage["pii"](spark, now, str(tmp_path)).cache()
    got = {x.doc_id: x.text for x in now.collect()}
    assert set(got) == kept_ids
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert got == {i: re.sub(mail, "[EMAIL]", want[i]) for i in kept_ids} and any("[EMAIL]" in t for t in got.values())
    tokens = Tokenizer.from_file(registry.vocabulary(registry.BYTE_VOCABULARY))
    pieces = stage["packing"](spark, now, str(tmp_path)).collect()
    total = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in got.items()}
    held = dict.fromkeys(total, 0)
    for x in pieces:
        held[x.doc_id] += x.length
    assert held == total and all(x.length & (x.length - 1) == 0 and x.length <= 2048 for x in pieces)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "word " * 80, "en", "s", 1), (2, "", "en", "s", 0), (3, "some words here " * 40, "en", "s", 1), (3, "some words here " * 40, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # All texts are too short or repeat themselves; runs of one line are no repeats of an earlier line here, and equal rows are one document.
    want = {"quality rules": [], "line dedup": ["1", "2", "3", "3", "None"], "near duplicates": ["1", "2", "3", "None"], "pii": ["1", "2", "3", "3", "None"]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert sorted(str(r.doc_id) for r in got.collect()) == want[name] and got.columns == docs.columns, name
    pieces = corpus_pipeline.packing(spark, docs, SMALL).collect()
    held = {}
    for x in pieces:
        held.setdefault(str(x.doc_id), []).append((x.start, x.length, x.doc_tokens))
    assert held["1"] == held["2"] == [(0, 1, 1)] and sorted(held) == ["1", "2", "3", "None"]
    assert sum(n for _, n, _ in held["3"]) == 2 * held["3"][0][2] and sum(n for _, n, _ in held["None"]) == held["None"][0][2]
    assert all(stage(spark, docs.where("false"), SMALL).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_rows_of_one_id_link_by_their_texts(spark):
    """An unlinked text stays whatever its id is, copies go whatever theirs are, and lone ids come first."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, text(1)), (7, text(2)), (7, text(1)), (5, text(3)), (9, text(2) + " end"), (None, text(3)), (5, text(3)), (12, text(4)), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()), key=str)
    assert got == sorted([(7, text(1)), (9, text(2) + " end"), (5, text(3)), (None, text(3)), (12, text(4)), (12, "")], key=str)
