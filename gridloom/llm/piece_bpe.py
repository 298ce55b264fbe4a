"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The model file gives pieces and scores. A text is normalised (identity rule, one space before it,
spaces written as U+2581) and cut into words where no piece can reach across: before a run of spaces,
and between any two characters that stand together in no piece. Distinct words that a worker has not
met are encoded together: their characters form one flat symbol array; each round takes the minimum
rank of adjacent pairs per word, merges all leftmost occurrences of that pair at once, drops the
words that have no pair left and compacts the rest. Characters without a piece become byte pieces.

Merging several occurrences in one round equals merging one at a time unless a pair made by the first
merge ranks below the pair being merged (or pairs tie in score); such words merge once in that round.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Recent, slices

_GAP = "▁"
_WORD = re.compile(" *[^ ]+| +")
_NONE = np.int32(2**31 - 1)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Pieces of a model file, and word ids learnt so far (``cache`` bounds each generation kept)."""

    def __init__(self, path: str, cache: int = 250_000):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [{"text": b"", "score": 0.0, "kind": _NORMAL} | {
            {1: "text", 2: "score", 3: "kind"}[k]: struct.unpack("<f", v)[0] if k == 2 else v for k, v in _fields(body) if k in (1, 2, 3)}
            for number, body in model if number == 1]
        rule = dict(field for number, body in model if number == 3 for field in _fields(body))
        if rule.get(1, b"") != b"identity" or rule.get(2) or not rule.get(3, 1) or rule.get(4, 1) or not rule.get(5, 1):
            raise ValueError("only the identity rule, with a space before the text and no space removed, is supported")
        if {p["kind"] for p in pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.words = Recent(cache)
        text = [p["text"].decode() for p in pieces]
        self.begin, self.end = text.index("<s>"), text.index("</s>")
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.out: list[bytes] = []  # what each id decodes to
        for i, p in enumerate(pieces):
            if p["kind"] == _BYTE:
                self.bytes[int(text[i][3:5], 16)] = i
            self.out.append(bytes([int(text[i][3:5], 16)]) if p["kind"] == _BYTE else text[i].replace(_GAP, " ").encode() if p["kind"] == _NORMAL else b"")
        if (self.bytes < 0).any():
            raise ValueError("a model without all byte pieces is not supported")
        normal = {text[i]: i for i, p in enumerate(pieces) if p["kind"] == _NORMAL}
        self.n = len(pieces)
        chars = sorted({c for t in normal for c in t})
        ids = dict(normal)
        for c in chars:  # a character that stands in pieces but is none
            ids.setdefault(c, self.n + len(ids))
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for c in chars:
            self.of_char[ord(c)] = ids[c]
        scores = np.array([pieces[i]["score"] for i in normal.values()])
        levels, place, times = np.unique(-scores, return_inverse=True, return_counts=True)
        self.rank = np.full(self.n, _NONE, dtype=np.int32)
        self.rank[list(normal.values())] = place
        self.tied = times > 1
        made = {}
        for t, i in normal.items():
            for cut in range(1, len(t)):
                if (a := ids.get(t[:cut])) is not None and (b := ids.get(t[cut:])) is not None:
                    made[a << 32 | b] = i
        self.pairs = np.array(sorted(made), dtype=np.int64)
        self.made = np.array([made[k] for k in self.pairs.tolist()], dtype=np.int32)
        self.beside = np.unique(np.array([ord(a) << 32 | ord(b) for t in normal for a, b in zip(t, t[1:])], dtype=np.int64))

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.made[at], np.int32(-1))

    def _ranked(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.rank[merged], _NONE)

    def learn(self, words: list[str]) -> None:
        """Encode words (spaces written as U+2581) and keep their ids."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.array([len(w) for w in words])
        first = np.zeros(len(points), dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        # Characters that stand together in no piece part segments, which are encoded apart.
        beside = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, beside), len(self.beside) - 1)
        cut = first.copy()
        cut[1:] |= self.beside[at] != beside
        owner = np.cumsum(cut) - 1
        symbols = self.of_char[points].astype(np.int64)
        symbols[symbols < 0] = -1 - points[symbols < 0]  # no piece: the character itself, which never merges
        done_at, done = self._rounds(symbols, owner)
        order = np.argsort(done_at, kind="stable")
        symbols, owner = done[order], done_at[order]
        word_of = (np.cumsum(first) - 1)[np.flatnonzero(cut)][owner]  # the word of each segment
        self._keep(words, symbols, word_of)

    def _keep(self, words: list[str], symbols: np.ndarray, word_of: np.ndarray) -> None:
        odd = (symbols < 0) | (symbols >= self.n)
        if odd.any():
            back = np.full(int(symbols.max(initial=0)) + 1, 0, dtype=np.int64)
            virtual = np.flatnonzero(self.of_char >= self.n)
            inside = self.of_char[virtual] < len(back)
            back[self.of_char[virtual[inside]]] = virtual[inside]
            spelt = {}
            for s in np.unique(symbols[odd]).tolist():
                char = chr(-1 - s if s < 0 else int(back[s]))
                spelt[s] = [int(self.bytes[b]) for b in char.encode("utf-8", "surrogatepass")]
            sizes = np.ones(len(symbols), dtype=np.int64)
            sizes[odd] = [len(spelt[s]) for s in symbols[odd].tolist()]
            flat, ends = np.repeat(symbols, sizes), np.cumsum(sizes)
            for i in np.flatnonzero(odd).tolist():
                flat[ends[i] - sizes[i]:ends[i]] = spelt[int(symbols[i])]
            symbols, word_of = flat, np.repeat(word_of, sizes)
        ends = np.cumsum(np.bincount(word_of, minlength=len(words))).tolist()
        data, known, start = symbols.astype("<u4").tobytes(), self.words.young, 0
        for word, end in zip(words, ends):
            known[word] = data[4 * start:4 * end]
            start = end

    def _rounds(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair remains; the segment and value of every symbol that is left."""
        out_owner, out = [], []
        merged = np.full(len(symbols), -1, dtype=np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        merged[inner] = self._merged(symbols[inner], symbols[inner + 1])
        rank = self._ranked(merged)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(symbols)]]))
            least = np.minimum.reduceat(rank, starts)
            open_ = least < _NONE
            if not open_.all():
                live = np.repeat(open_, sizes)
                out_owner.append(owner[~live])
                out.append(symbols[~live])
                symbols, owner, rank, merged = symbols[live], owner[live], rank[live], merged[live]
                if not len(symbols):
                    break
                least, sizes = least[open_], sizes[open_]
                starts = np.cumsum(sizes) - sizes
            place = np.arange(len(symbols))
            chosen = rank == np.repeat(least, sizes)
            leftmost = np.minimum.reduceat(np.where(chosen, place, len(place)), starts)
            before = np.concatenate([[False], chosen[:-1]])
            run = np.maximum.accumulate(np.where(chosen & ~before, place, 0))
            many = chosen & ((place - run) % 2 == 0)
            single = self.tied[least]
            while True:
                alone = np.repeat(single, sizes)
                take = np.where(alone, False, many)
                take[leftmost[single]] = True
                new = self._apply(symbols, owner, merged, rank, take)
                worse = new[4] & (new[3] < np.repeat(least, sizes)[new[5]])
                if not worse.any():
                    break
                # A pair made by a merge comes first: such segments merge once in this round.
                bad = np.zeros(len(sizes), dtype=bool)
                bad[np.repeat(np.arange(len(sizes)), sizes)[new[5]][worse]] = True
                bad &= ~single & (np.add.reduceat(take.astype(np.int64), starts) > 1)
                if not bad.any():
                    break
                single = single | bad
            symbols, owner, merged, rank = new[:4]
        return (np.concatenate(out_owner), np.concatenate(out)) if out else (owner, symbols)

    def _apply(self, symbols, owner, merged, rank, take):
        """State after the merges in ``take``; which pairs are new; the old place of each symbol."""
        keep = np.ones(len(symbols), dtype=bool)
        keep[np.flatnonzero(take) + 1] = False
        old = np.flatnonzero(keep)
        fresh = take[old]
        new = np.where(fresh, merged[old], symbols[old])
        own, made, ranks = owner[old], merged[old], rank[old]
        touched = fresh.copy()
        touched[:-1] |= fresh[1:]
        at = np.flatnonzero(touched)
        inner = at[(at + 1 < len(new)) & (own[np.minimum(at + 1, len(new) - 1)] == own[at])]
        made[at] = -1
        made[inner] = self._merged(new[inner], new[inner + 1])
        ranks[at] = self._ranked(made[at])
        return new, own, made, ranks, touched, old

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end ids, little-endian unsigned 32-bit."""
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        out: list[bytes] = []
        for at in range(0, len(texts), 250):
            cut = [_WORD.findall(" " + t.replace(_GAP, " ")) if t else [] for t in texts[at:at + 250]]
            missing = self.words.lacks(set().union(*cut))
            if missing:
                self._learn_spaced(missing)
            known = self.words.young.__getitem__
            out += [begin + b"".join(map(known, c)) + end for c in cut]
        return out

    def _learn_spaced(self, words: list[str]) -> None:
        """Words with plain spaces, in steps of bounded size."""
        at, size, some = 0, 0, []
        for word in words:
            some.append(word)
            size += len(word)
            if size > 400_000:
                self._learn_step(some)
                size, some = 0, []
        if some:
            self._learn_step(some)

    def _learn_step(self, words: list[str]) -> None:
        written = [w.replace(" ", _GAP) for w in words]
        self.learn(written)
        for plain, w in zip(words, written):
            self.words.young[plain] = self.words.young.pop(w)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces give nothing, the space put before the text goes again."""
        out = b"".join(map(self.out.__getitem__, ids.tolist()))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_LOADED: dict[str, PieceModel] = {}


def loaded(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every text, begin and end ids included.

    A null text counts as empty (two ids); null and repeated document ids keep their rows; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in slices(batches, 1000):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "ids": pa.array(model.encode(batch.column(1).to_pylist()), pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``, to a frame of doc_id and ids. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in slices(batches, 1000):
            texts = [None if b is None else model.decode(np.frombuffer(b, "<u4")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": batch.column(1), "decoded": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def pieces_query(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode what was encoded, and digest both."""
    return decode(encode(docs, path), path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
