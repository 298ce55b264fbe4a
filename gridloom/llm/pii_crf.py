"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The field labels white-space tokens with O or one of the kinds. Its features are word shapes (letters,
digits and marks with runs collapsed), digit counts and a few cue words, of the token and of both
neighbours. It is trained on a small labelled table (``labelled_table``) by gradient ascent on the
conditional likelihood, with forward-backward sums over padded batches. The table lies beside this
module (``pii_labelled.tsv``): a row of it is a text, its tokens are parted by tabs, and a token that is
not O has its kind behind a space.

Decoding is Viterbi in numpy batches. A token whose margin for O over each kind exceeds all that the
kind could gain from transitions to both sides is O on every best path, so the chain is cut there and
only what lies between such tokens is decoded; the result is the best path of the whole text.

Secrets (keys, tokens, passwords) are found by the field alone. A found run of the other kinds becomes a
span only if it also passes the exact check of its kind (digit counts, Luhn, address syntax). Runs that
touch a span of the fixed patterns give none; the patterns' spans always stay.
"""

from __future__ import annotations

import bisect
import functools
import ipaddress
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", *KINDS)
_TABLE = Path(__file__).with_name("pii_labelled.tsv")

# The base patterns, each in a form that reads a text once. Around an @: what may stand
# before it, and the rest. Addresses are fours of a chain of numbers parted by single dots.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile(r"(.)\1+", re.S)
_TOKEN = re.compile(r"\S+")
# Words that hint at what stands beside them.
_CUES = frozenset("at dot tel phone call mobile fax email mail e-mail contact ip host address server card visa account number token secret key password api_key".split())


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = _LOCAL.match(text[free:at][::-1])
        rest = _DOMAIN.match(text, at) if before else None
        if rest:
            yield at - before.end(), rest.end()
        free = rest.end() if rest else at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts up to 255."""
    for chain in _CHAIN.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in four):
                yield start, start + size
            start += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind and start; failing matches are dropped.
    The time is in proportion to the text, whatever it holds."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *span) for span in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m.group())
                if 13 <= len(d) <= 19 and _luhn(d):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


class _Shapes(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c if point < 128 else "¤"
        return out


_SHAPES = _Shapes()


def cue_of(name: str) -> str:
    return "cue" if name.lower() in _CUES else ""


def features(token: str) -> tuple[str, ...]:
    """Features of one token."""
    cue = token.lower().strip("()[]:.,")
    if token.isalpha() and (token.islower() or token[1:].islower() and token[0].isupper()):
        return ("sx" if token.islower() else "sXx", "d0", f"c{cue}" if cue in _CUES else "c", "eFalseFalseFalseFalse", "l")
    shape = _RUN.sub(r"\1", token.translate(_SHAPES))[:12]
    digits = sum(map(token.count, "0123456789"))
    bucket = digits if digits <= 4 else 5 if digits < 7 else 6 if digits < 13 else 7 if digits < 20 else 8
    core = token.strip("\"'`()[]{}<>.,;:!?")
    name, _, value = core.rpartition("=")
    mixed = value.replace("-", "").replace("_", "").isalnum() and any("0" <= c <= "9" for c in value) and not value.isdigit()
    long_ = f"l{min(len(value), 32) // 8}{cue_of(name)}" if mixed and len(value) >= 12 else "l"
    return (f"s{shape}", f"d{bucket}", f"c{cue}" if cue in _CUES else "c", f"e{token[:1] in '+('}{'@' in token}{token.count('.') == 3}{token.count(':') > 2}", long_)


Table = list[tuple[list[str], list[str]]]


def labelled_table(path: Path = _TABLE) -> Table:
    """Rows of the labelled table: tokens and their labels. It has decoys too: dates, versions, amounts."""
    out = []
    for row in path.read_text(encoding="utf-8").splitlines():
        cells = [cell.partition(" ") for cell in row.split("\t")]
        out.append(([token for token, _, _ in cells], [kind or "O" for _, _, kind in cells]))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> CrfModel:
    """The field of the stored table, fitted once in a process."""
    return train(labelled_table())


class CrfModel:
    """Weights of the field; ``own``, ``before`` and ``after`` are by feature, ``move`` by label pair."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, move: np.ndarray):
        self.index, self.weights, self.move = index, weights, move

    def rows(self, token: str) -> np.ndarray:
        """Scores that a token gives to itself, to the next token and to the one before it."""
        known = [i for f in features(token) if (i := self.index.get(f)) is not None]
        return self.weights[:, known].sum(axis=1) if known else np.zeros((3, len(LABELS)))


def train(table: Table, steps: int = 120, rate: float = 0.15, penalty: float = 2e-4) -> CrfModel:
    """Fit the field to a labelled table by gradient ascent (Adam)."""
    index: dict[str, int] = {}
    given = [[[index.setdefault(f, len(index)) for f in features(t)] for t in tokens] for tokens, _ in table]
    batch = _padded(given, [[LABELS.index(x) for x in labels] for _, labels in table], len(index))
    size = len(LABELS)
    weights, move = np.zeros((3, len(index) + 1, size)), np.zeros((size, size))
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        _, grad, grad_move = likelihood(weights, move, *batch)
        grad = grad - penalty * weights
        grad[:, -1] = 0
        grad_move = grad_move - 100 * penalty * move
        for value, g, a, b in ((weights, grad, moment[0], moment[1]), (move, grad_move, moment[2], moment[3])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            value += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return CrfModel(index, weights[:, :-1], move)


def _padded(given: list[list[list[int]]], labels: list[list[int]], features_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens' feature lists with a place before and behind, those lists (the first, and the
    last row of weights, are padding), labels, mask."""
    n, most, per = len(given), max(map(len, given)), len(features("x"))
    number = {(features_,) * per: 0}
    ids = np.zeros((n, most + 2), dtype=np.int64)
    gold, mask = np.zeros((n, most), dtype=np.int64), np.zeros((n, most), dtype=bool)
    for i, (own, marks) in enumerate(zip(given, labels)):
        ids[i, 1:len(own) + 1] = [number.setdefault(tuple(f), len(number)) for f in own]
        gold[i, :len(own)] = marks
        mask[i, :len(own)] = True
    return ids, np.array(list(number)), gold, mask


def likelihood(weights: np.ndarray, move: np.ndarray, ids: np.ndarray, lists: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the gold labels and its gradients by weights and label moves, from
    forward-backward sums."""
    n, most = gold.shape
    want = np.eye(move.shape[0])[gold] * mask[..., None]
    scores = weights[:, lists].sum(axis=2)
    emit = scores[0][ids[:, 1:-1]] + scores[1][ids[:, :-2]] + scores[2][ids[:, 2:]]
    # Scaled sums: each step's forward sums are divided by their total, whose logarithms add up.
    top, high = emit.max(axis=2, keepdims=True), move.max()
    near, step = np.exp(emit - top), np.exp(move - high)
    forward, backward, total = np.zeros_like(emit), np.ones_like(emit), np.ones((n, most))
    total[:, 0] = near[:, 0].sum(axis=1)
    forward[:, 0] = near[:, 0] / total[:, :1]
    for t in range(1, most):
        new, live = (forward[:, t - 1] @ step) * near[:, t], mask[:, t]
        total[live, t] = new[live].sum(axis=1)
        forward[live, t] = new[live] / total[live, t, None]
    pair_got = np.zeros_like(move)
    for t in range(most - 2, -1, -1):
        live = mask[:, t + 1]
        after = near[live, t + 1] * backward[live, t + 1] / total[live, t + 1, None]
        backward[live, t] = after @ step.T
        pair_got += step * (forward[live, t].T @ after)
    got = forward * backward * mask[..., None]
    whole = ((np.log(total) + top[:, :, 0]) * mask).sum(axis=1) + high * (mask.sum(axis=1) - 1)
    pair_gold = np.einsum("nta,ntb->ab", want[:, :-1], want[:, 1:])
    grad = np.zeros_like(weights)
    for k, shift in enumerate((slice(1, -1), slice(0, -2), slice(2, None))):
        of_list = np.zeros((len(lists), move.shape[0]))
        np.add.at(of_list, ids[:, shift], want - got)
        np.add.at(grad[k], lists, of_list[:, None, :])
    gained = (emit * want).sum() + (pair_gold * move).sum() - whole.sum()
    return float(gained / n), grad / n, (pair_gold - pair_got) / n


def viterbi(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of padded chains that stand between two tokens labelled O (label 0)."""
    n, most, _ = emit.shape
    back = np.zeros((n, most, emit.shape[2]), dtype=np.int8)
    score = move[0][None] + emit[:, 0]
    final = score.copy()
    for t in range(1, most):
        reach = score[:, :, None] + move[None]
        back[:, t] = reach.argmax(axis=1)
        score = reach.max(axis=1) + emit[:, t]
        final = np.where((lengths > t)[:, None], score, final)
    path = np.zeros((n, most), dtype=np.int8)
    label = (final + move[:, 0][None]).argmax(axis=1)
    for t in range(most - 1, -1, -1):
        path[:, t] = np.where(lengths > t, label, 0)
        if t:
            label = np.where(lengths > t, back[np.arange(n), t, label], label)
    return path


class Tagger:
    """Labels tokens of texts; keeps the scores of at most ``limit`` distinct words."""

    def __init__(self, model: CrfModel, limit: int = 500_000, chars: int = 16_000_000):
        self.model, self.limit, self.chars = model, limit, chars
        # What a label can gain over O through the transitions to both sides.
        move = model.move
        self.gain = (move[:, 1:] - move[:, :1]).max(axis=0) + (move[1:] - move[:1]).max(axis=1)
        self._reset()

    def _reset(self) -> None:
        self.of_word: dict[str, int] = {}
        self.held = 0
        self.of_features: dict[tuple[str, ...], int] = {(): 0}
        self.table = np.zeros((3, 256, len(LABELS)), dtype=np.float64)  # row 0: between texts

    def _row(self, token: str) -> int:
        key = features(token)
        row = self.of_features.get(key)
        if row is None:
            row = self.of_features[key] = len(self.of_features)
            if row >= self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.table[:, row] = self.model.rows(token)
        return row

    def labels(self, tokens: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each token list."""
        if len(self.of_word) > self.limit or self.held > self.chars:
            self._reset()
        for word in set().union(*tokens).difference(self.of_word):
            self.of_word[word] = self._row(word)
            self.held += len(word)
        known, flat = self.of_word.__getitem__, [0]
        for own in tokens:
            flat.extend(map(known, own))
            flat.append(0)
        ids = np.array(flat, dtype=np.int64)
        emit = self.table[0][ids]
        emit[1:] += self.table[1][ids[:-1]]
        emit[:-1] += self.table[2][ids[1:]]
        open_ = (emit[:, 0] <= (emit[:, 1:] + self.gain).max(axis=1)) & (ids > 0)
        out = np.zeros(len(ids), dtype=np.int8)
        at = np.flatnonzero(open_)
        if len(at):
            first = np.concatenate([[True], np.diff(at) > 1])
            starts, sizes = at[first], np.diff(np.concatenate([np.flatnonzero(first), [len(at)]]))
            order = np.argsort(sizes, kind="stable")
            lo = 0
            while lo < len(order):  # chains of like length together, a bounded number of cells at once
                hi, longest = lo, 0
                while hi < len(order) and (hi == lo or (hi - lo) * int(sizes[order[hi]]) < 60_000):
                    longest = int(sizes[order[hi]])
                    hi += 1
                some = order[lo:hi]
                where = starts[some][:, None] + np.arange(longest)[None]
                inside = np.arange(longest)[None] < sizes[some][:, None]
                path = viterbi(emit[np.minimum(where, len(ids) - 1)], sizes[some], self.model.move)
                out[where[inside]] = path[inside]
                lo = hi
        result, at = [], 1
        for own in tokens:
            result.append(out[at:at + len(own)])
            at += len(own) + 1
        return result


def _valid(kind: int, text: str) -> bool:
    """The exact check of a found run."""
    if kind == 4:
        return True
    d = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*(@|[\[(]?\bat\b[\])]?)\s*[A-Za-z0-9-]+((\.|\s*[\[(]?\bdot\b[\])]?\s*)[A-Za-z0-9-]+)+", text, re.I))
    if kind == 1:
        try:
            return ipaddress.ip_address(text) is not None and ("." in text or text.count(":") >= 3)
        except ValueError:
            return False
    if kind == 2:
        return 13 <= len(d) <= 19 and _luhn(d) and re.fullmatch(r"[0-9]([ ./-]?[0-9])+", text) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"(\(\+[0-9]+\) ?|\+|00)?[0-9(][0-9 ().-]*[0-9]", text) is not None and bool(re.search(r"[ ().-]|^\+|^00", text))


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: base spans, and base and found spans together by kind and start."""
    out = []
    for text, labels in zip(texts, tagger.labels([t.split() for t in texts])):
        base = base_spans(text)
        found = []
        taken, starts = [], []
        for a, b in sorted((a, b) for _, a, b in base):  # spans of different kinds may overlap
            if taken and a < taken[-1]:
                taken[-1] = max(taken[-1], b)
            else:
                starts.append(a)
                taken.append(b)
        if labels.any():
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            at = np.flatnonzero(labels)
            for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(labels[at]) != 0)) + 1):
                start, end = tokens[run[0]][0], tokens[run[-1]][1]
                kind = int(labels[run[0]]) - 1
                while end > start and text[end - 1] in ".,;:!?\"'>]}&%$#*|":
                    end -= 1
                while start < end and text[start] in "\"'<[{:":
                    start += 1
                k = bisect.bisect_left(starts, end) - 1  # the last span of the patterns that begins before the end
                if start < end and _valid(kind, text[start:end]) and (k < 0 or taken[k] <= start):
                    found.append((kind, start, end))
        out.append((base, sorted(base + found)))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: CrfModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (base spans) and spans (all spans), each as kind:start:end in code points, by kind
    then start, comma-joined.

    A null text counts as empty and has no spans. Null and repeated ids keep their rows; an empty table
    gives no rows; other columns are ignored.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for some in slices(batches):
            spans = all_spans([t or "" for t in some.column(1).to_pylist()], tagger)
            yield pa.RecordBatch.from_pydict({
                "doc_id": some.column(0), "base": pa.array([_joined(b) for b, _ in spans], pa.string()), "spans": pa.array([_joined(a) for _, a in spans], pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, base string, spans string")


def redact(docs: DataFrame, model: CrfModel | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in the text replaced by its kind in brackets (spans that
    overlap become one). Null texts stay null; all other columns and rows stay as they are."""
    model = model or trained()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for some in slices(batches):
            texts = some.column(place).to_pylist()
            spans = all_spans([t or "" for t in texts], tagger)
            new = pa.array([None if t is None else redacted(t, a) for t, (_, a) in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(some.columns)], names=some.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with spans replaced by their kind in brackets; overlapping spans take the first's kind."""
    out, at, last = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < last:
            if end > last:
                at = last = end
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = last = end
    return "".join(out) + text[at:]


def pii_query(docs: DataFrame) -> DataFrame:
    """Counts of the patterns' spans by kind, their digest, all spans; then how many secrets and how many
    spans of any kind there are."""
    found = find_pii(docs)
    count = lambda spans, kind: F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(kind) & (s != ""))).cast("long")
    return found.select(
        "doc_id", *[count("base", f"{k}:").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
        count("spans", "secret:").alias("n_secret"), count("spans", "").alias("n_spans"))
