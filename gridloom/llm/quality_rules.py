"""Quality rules: a decision list learnt by sequential covering, applied as Spark conditional expressions.

Statistics of a text are DataFrame expressions over its words and lines; no Python runs on rows. From
labelled statistics (a bounded sample), rules are grown one after another: a rule is a conjunction of
threshold conditions that is grown, condition by condition, to raise its information gain on a growing
part of the labelled rows, and pruned back on the other part. Rows that a rule covers are set aside;
learning stops when a new rule is no better than a stated precision. The list is emitted as ordered
``CASE WHEN`` conditions: the first rule that holds decides, and a text that no rule covers is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_GAP, labelled_sample, unused

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may ask: shares of a text, so thresholds mean the same for short and long texts.
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "mean_word", "upper_share", "pipe_share", "bang_share",
            "digit_share", "ended_share", "distinct_share", "line_words")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base statistics and the features of rules to ``docs``; see ``BASE`` and ``FEATURES``.

    Repeated 3-word windows: positions of windows found again come from a membership test while
    there are few such windows, else from a sort of (hash, position) pairs. A window covers three
    words, less what the next one covers.

    A null text has no words and all counts 0; an empty table stays empty. Columns of ``docs`` that
    have the same names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in {*BASE, *FEATURES}]
    words, lines, windows, pairs, sorted_, twice, at = unused(docs, "words", "lines", "windows", "pairs", "sorted", "twice", "at")
    counts = unused(docs, "line_count", "upper", "pipes", "bangs", "digits", "ends", "kinds")
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], t.alias(at), _words(t).alias(words), full.alias(lines))
    text = at
    n = F.size(words)
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(
            w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2))))
    frame = frame.withColumn(windows, hashes)
    frame = frame.withColumn(sorted_, F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.array().cast("array<bigint>"))
                             .otherwise(F.sort_array(windows)))
    frame = frame.withColumn(twice, F.array_distinct(F.filter(sorted_, lambda h, i: (i > 0) & (h == F.get(F.col(sorted_), i - 1)))))
    few = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
    frame = frame.withColumn(pairs, F.when(F.size(twice) > 32, F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col(pairs), j)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    places, = unused(frame, "places")
    frame = frame.withColumn(places, F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) > 32, many).otherwise(few))
    covered = F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col(places), j + 1), p + 3) - p)),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    t = F.col(text)
    chars = F.length(F.regexp_replace(t, WORD_GAP, ""))
    count = lambda pattern: F.length(t) - F.length(F.translate(t, pattern, ""))
    ended = F.size(F.filter(lines, lambda x: x.rlike("[.!?][\\x20\\x09-\\x0D]*$")))
    extra = (F.size(lines), F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", "")), count("|"), count("!"), count("0123456789"), ended, F.size(F.array_distinct(words)))
    frame = frame.select(
        *[F.col(f"`{c}`") for c in keep], n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        count("#*$%&|<>").cast("long").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), *[x.alias(name) for x, name in zip(extra, counts)])
    line_count, upper, pipes, bangs, digits, ends, kinds = counts
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    of = {"symbol_share": ("n_symbols", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", line_count), "mean_word": ("word_chars", "n_words"),
          "upper_share": (upper, "word_chars"), "pipe_share": (pipes, "word_chars"), "bang_share": (bangs, "word_chars"), "digit_share": (digits, "word_chars"),
          "ended_share": (ends, line_count), "distinct_share": (kinds, "n_words"), "line_words": ("n_words", line_count)}
    return frame.select(*[F.col(f"`{c}`") for c in keep], *BASE, *[share(*of[name]).alias(name) for name in FEATURES])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        x = rows[:, names.index(self.feature)]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x, y = F.col(self.feature), F.lit(self.threshold)
        return x > y if self.above else x <= y


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(rows), dtype=bool)
    for c in rule:
        out &= c.holds(rows, names)
    return out


def _grow(rows: np.ndarray, bad: np.ndarray, names: tuple[str, ...], most: int) -> Rule:
    """Add the condition of highest information gain until the rule covers no good row."""
    rule: list[Condition] = []
    while len(rule) < most:
        held = _covers(tuple(rule), rows, names)
        p0, n0 = int((held & bad).sum()), int((held & ~bad).sum())
        if not n0 or not p0:
            break
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, name in enumerate(names):
            x, y = rows[held, j], bad[held]
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            cut = np.flatnonzero(x[1:] > x[:-1])
            left_p, left_n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
            for above, p, n in ((False, left_p, left_n), (True, p0 - left_p, n0 - left_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1)
                if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                    best = float(gain[k]), Condition(name, above, float((x[cut[k]] + x[cut[k] + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
    return tuple(rule)


def _prune(rule: Rule, rows: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Rule:
    """Drop final conditions as long as the worth (p - n) / (p + n) on the other part does not fall."""
    def worth(r: Rule) -> float:
        held = _covers(r, rows, names)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(rows: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, precision: float = 0.95,
                most_rules: int = 12, most_conditions: int = 4, least: int = 3) -> list[Rule]:
    """Sequential covering over labelled statistics: rules for bad rows, in the order they were found."""
    rules: list[Rule] = []
    rows, bad = np.asarray(rows, dtype=float).reshape(-1, len(names)), np.asarray(bad, dtype=bool)
    part = np.arange(len(rows)) % 3 == 2  # every third row prunes
    while len(rules) < most_rules and int(bad.sum()) >= least:
        rule = _prune(_grow(rows[~part], bad[~part], names, most_conditions), rows[part], bad[part], names)
        held = _covers(rule, rows, names) if rule else np.zeros(len(rows), dtype=bool)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if not rule or p < least or p < precision * (p + n):
            break
        rules.append(rule)
        rows, bad, part = rows[~held], bad[~held], part[~held]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        held = rule[0].column()
        for c in rule[1:]:
            held = held & c.column()
        out = F.when(held, F.lit(k)) if out is None else out.when(held, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learnt(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 20_000, min_words: int = 50) -> list[Rule]:
    """Rules from a bounded sample: at most ``sample_rows`` labelled documents of at most
    ``sample_chars`` characters, none of the held-out fold. Those that the base rules reject are left
    out: the list has to tell apart what they keep. Without labels, no rules."""
    stats = statistics(labelled_sample(docs, labels, "quality", sample_rows, sample_chars))
    # Tested here, not by a filter, which would be pushed below the statistics and repeat their steps.
    got = [r for r in stats.select("n_words", "n_repeat_words", "label", *FEATURES).collect() if r[0] >= min_words and 100 * r[1] <= 50 * r[0]]
    return learn_rules(np.array([r[3:] for r in got], dtype=float).reshape(-1, len(FEATURES)), np.array([r[2] == 0 for r in got], dtype=bool))


def base_failed(min_words: int = 50) -> Column:
    """Fewer than ``min_words`` words, or more than half of the words in repeated 3-word windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, rules: list[Rule], min_words: int = 50) -> DataFrame:
    """``docs`` with the base statistics, ``rule`` (the deciding rule, 0 for none), ``base_failed`` and ``kept``.

    See ``base_failed`` for the base rules. A null text has no words and fails. Null ids and repeated rows are judged like any other.
    """
    # A filter on a verdict must not be pushed below the statistics: put into one condition, their shared
    # steps would be worked out again and again. A condition that is not deterministic, and always
    # true, keeps it above.
    once = lambda x: F.when(F.monotonically_increasing_id() >= 0, x)
    out = statistics(docs)
    out = out.withColumns({"base_failed": once(base_failed(min_words)), "rule": once(verdict(rules))})
    return out.withColumn("kept", once(~F.col("base_failed") & (F.col("rule") == 0)))


def quality_rules_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, learnt(docs, labels)).select("doc_id", *BASE, "base_failed", "kept", "rule")
