"""Exact sub-word ids at high speed: texts are cut where the tokenizer's own pre-tokenizer always
cuts, each distinct chunk goes through the ``tokenizers`` library once, and the ids are kept.

Two kinds of vocabulary are handled. ``byte``: byte-level BPE in which a single space joins the word
that follows it. ``word``: lower-cased BPE that drops white space. For both, a token never holds
white space after other characters, so ids of chunks, put together, are the ids of the text.
"""

from __future__ import annotations

import os
import re
from array import array

#: Unicode white space as the library's regular expressions see it (fixed values).
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BYTE_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_CHUNK = re.compile(f"[^{_SPACE}]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: How byte-level vocabularies write a byte: printable characters stand for themselves, others follow from 256 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Two gaps side by side, and white space other than spaces and line ends.
_GAPS = ("  ", "\n ", " \n", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
#: str.split() also cuts at these four; texts that hold them take the regular expression.
_ODD_GAPS = re.compile("[\\x1c-\\x1f]")


class _Chunks(dict):
    """Ids of the chunks met so far, worked out when they are first asked for. When ``limit`` chunks, or
    ``chars`` characters of them, are held, they become the old generation; a chunk that is asked for again
    comes back from it."""

    def __init__(self, made, limit: int, chars: int):
        self.made, self.limit, self.chars, self.held, self.old = made, limit, chars, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        if "\n" in chunk:
            return self.made(chunk)  # two lines: seldom met again
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.made(chunk)
        self.held += len(chunk)
        self[chunk] = ids
        return ids

    def turn(self) -> None:
        """Called between texts, so that nothing goes while it is in use."""
        if len(self) > self.limit or self.held > self.chars:
            self.old, self.held = dict(self), 0
            self.clear()


class ChunkTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does for whole texts.

    ``cache`` and ``chars`` bound each of two generations of what a worker keeps; texts are never cut.
    Strings of special tokens in a text become those tokens, as the library has it by default.
    """

    def __init__(self, path: str, kind: str, cache: int = 500_000, chars: int = 8_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError("kind is 'byte' or 'word'")
        self.kind = kind
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks = _Chunks(self._word_chunk if kind == "word" else self._byte_chunk, cache, chars)
        self.spaced = _Chunks(self._spaced_chunk, cache, chars)  # keyed without the space before them

    def split(self, text: str) -> list[str]:
        if self.kind == "byte":
            return _BYTE_CHUNK.findall(text)
        return _WORD_CHUNK.findall(text) if _ODD_GAPS.search(text) else text.split()

    def _whole(self, text: str) -> bytes:
        """Ids of a text by the library's whole pipeline."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _tokens(self, word: str) -> bytes:
        """Ids of a word of plain Latin letters, written as the vocabulary writes its bytes. It is one token
        run that normalisation leaves alone, so the library's model takes it at once."""
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _marked(self, chunk: str) -> bytes | None:
        """Ids of letters that ASCII marks follow: the marks are a token run of their own, so both parts are
        chunks themselves."""
        core = chunk.rstrip(_MARKS)
        if core and core != chunk and core[-1].isalpha() and core[-1] < "\u0130":
            return self.chunks[core] + self.chunks[chunk[len(core):]]
        return None

    def _word_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            lower = chunk.lower()
            if chunk.isascii():
                return self._tokens(chunk) if lower == chunk else self.chunks[lower]
            if max(chunk) < "\u0130":
                return self._tokens(lower.encode().decode("latin-1").translate(_BYTE_CHARS))
        elif (ids := self._marked(chunk)) is not None:
            return ids
        return self._whole(chunk)

    def _byte_word(self, word: str, space: str) -> bytes | None:
        if not word.isascii():
            if max(word) >= "\u0130":
                return None
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return self._tokens(space + word)

    def _byte_chunk(self, chunk: str) -> bytes:
        if chunk[0] == " " and len(chunk) > 1 and not chunk.isspace():
            return self.spaced[chunk[1:]]
        ids = self._byte_word(chunk, "") if chunk.isalpha() else self._marked(chunk)
        return self._whole(chunk) if ids is None else ids

    def _spaced_chunk(self, piece: str) -> bytes:
        """Ids of what stands between one space and the next, with the space before it."""
        if piece.isalpha():
            ids = self._byte_word(piece, _BYTE_CHARS[32])
        elif "\n" in piece:
            return b"".join(map(self.chunks.__getitem__, _BYTE_CHUNK.findall(" " + piece)))
        else:
            core = piece.rstrip(_MARKS)
            marked = core and core != piece and core[-1].isalpha() and core[-1] < "\u0130"
            ids = self.spaced[core] + self.chunks[piece[len(core):]] if marked else None
        return self._whole(" " + piece) if ids is None else ids

    def _ids(self, text: str) -> bytes:
        if self.kind == "byte" and not any(x in text for x in _GAPS):
            # White space is single spaces and line ends with none beside them: pieces between spaces do not
            # depend on each other.
            first, *rest = text.split(" ")
            return b"".join(map(self.chunks.__getitem__, _BYTE_CHUNK.findall(first))) + b"".join(map(self.spaced.__getitem__, rest))
        return b"".join(map(self.chunks.__getitem__, self.split(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        out = []
        for text in texts:
            # Texts with special strings go to the library whole.
            out.append(b"" if not text else self._whole(text) if any(s in text for s in self.special) else self._ids(text))
            self.chunks.turn()
            self.spaced.turn()
        return out


_LOADED: dict[tuple[str, str], ChunkTokenizer] = {}


def loaded(path: str, kind: str) -> ChunkTokenizer:
    """One tokenizer, with what it has learnt, for all tasks of a Python worker."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = ChunkTokenizer(path, kind)
    return _LOADED[path, kind]
