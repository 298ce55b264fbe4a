"""Which bytes of a file a selection needs.

A selection gives positions for every dimension of a variable, either dimension by dimension (a product
of lists) or with two dimensions paired (points of a path). Each list has the byte offset that a position
adds, so a value's place in the file is a sum, whatever dimensions are paired or records interleaved.
A selection is cut into blocks of bounded size along any dimension, blocks into byte runs, and runs whose
gap is small are read as one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Runs closer than this are read as one; none is longer than ``LONGEST``.
GAP, LONGEST = 4096, 8 << 20


@dataclass(frozen=True)
class Slab:
    """Positions of a variable: for each group of dimensions (outermost first) the dimensions, an array of
    positions (one column for each dimension) and the byte offsets that they add."""

    begin: int
    itemsize: int
    dims: tuple[tuple[int, ...], ...]
    positions: tuple[np.ndarray, ...]
    offsets: tuple[np.ndarray, ...]

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(len(o) for o in self.offsets)

    @property
    def n_values(self) -> int:
        return int(np.prod(self.lengths, dtype=np.int64))

    def part(self, cuts: tuple[tuple[int, int], ...]) -> "Slab":
        return Slab(self.begin, self.itemsize, self.dims, tuple(p[a:b] for p, (a, b) in zip(self.positions, cuts)), tuple(o[a:b] for o, (a, b) in zip(self.offsets, cuts)))

    def blocks(self, most: int) -> Iterator["Slab"]:
        """The slab in parts of at most ``most`` values, whole along the inner groups as far as they fit."""
        steps, room = [1] * len(self.lengths), max(1, most)
        for g in range(len(steps) - 1, -1, -1):
            steps[g] = max(1, min(self.lengths[g], room))
            room = max(1, room // steps[g])
        for starts in itertools.product(*(range(0, n, s) for n, s in zip(self.lengths, steps))):
            yield self.part(tuple((a, min(n, a + s)) for a, n, s in zip(starts, self.lengths, steps)))

    def places(self) -> np.ndarray:
        """Byte offset of every value, the last group running fastest."""
        out = np.full(1, self.begin, dtype=np.int64)
        for o in self.offsets:
            out = (out[:, None] + o).ravel()
        return out

    def at(self, dim: int) -> np.ndarray:
        """Position in one dimension of every value, in the order of ``places``."""
        for g, own in enumerate(self.dims):
            if dim in own:
                before, after = int(np.prod(self.lengths[:g], dtype=np.int64)), int(np.prod(self.lengths[g + 1:], dtype=np.int64))
                return np.tile(np.repeat(self.positions[g][:, own.index(dim)], after), before)
        raise KeyError(dim)


def slab(begin: int, itemsize: int, strides: tuple[int, ...], wanted: list[np.ndarray], paired: tuple[int, int] | None = None) -> Slab:
    """A slab of positions ``wanted`` in each dimension, of which two may be paired (their arrays then have
    one length and go together). ``strides`` are bytes."""
    groups: list[tuple[int, ...]] = []
    for d in range(len(strides)):
        if paired and d in paired:
            if d == min(paired):
                groups.append(tuple(sorted(paired)))
        else:
            groups.append((d,))
    positions, offsets = [], []
    for own in groups:
        p = np.stack([np.asarray(wanted[d], dtype=np.int64) for d in own], axis=1).reshape(-1, len(own))
        o = p @ np.array([strides[d] for d in own], dtype=np.int64)
        order = np.argsort(o, kind="stable")  # near points stand together
        positions.append(p[order])
        offsets.append(o[order])
    return Slab(begin, itemsize, tuple(groups), tuple(positions), tuple(offsets))


def byte_runs(places: np.ndarray, itemsize: int, gap: int = GAP, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """First and last element (exclusive) of each run of ascending byte places."""
    if not len(places):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = (np.diff(places) > gap + itemsize) | (np.diff((places - places[0]) // longest) > 0)
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return first, np.concatenate([first[1:], [len(places)]])


def fetch(file, start: int, size: int) -> bytes:
    """The only place where values are read from a file."""
    file.seek(start)
    return file.read(size)


def read(file, part: Slab, dtype: str, gap: int = GAP) -> np.ndarray:
    """Values of a slab in the order of its ``places``."""
    kind, places = np.dtype(dtype), part.places()
    order = None if (np.diff(places) > 0).all() else np.argsort(places, kind="stable")
    asked = places if order is None else places[order]
    out = np.empty(len(asked), dtype=kind)
    for a, b in zip(*byte_runs(asked, part.itemsize, gap)):
        start, within = int(asked[a]), asked[a:b] - asked[a]
        raw = np.frombuffer(fetch(file, start, int(within[-1]) + part.itemsize), np.uint8)
        if (within % part.itemsize == 0).all():
            out[a:b] = raw[:len(raw) // part.itemsize * part.itemsize].view(kind)[within // part.itemsize]
        else:  # records of other variables lie between
            out[a:b] = raw[within[:, None] + np.arange(part.itemsize)].reshape(-1).view(kind)
    if order is not None:
        back = np.empty_like(out)
        back[order] = out
        return back
    return out


def plan(part: Slab, gap: int = GAP) -> dict[str, int | float]:
    """What reading a slab takes: values asked for, byte runs, bytes read, and their ratio to the bytes asked for.

    Meant for selections small enough for one block; larger ones are planned block by block."""
    places = np.sort(part.places())
    first, last = byte_runs(places, part.itemsize, gap)
    n = int((places[last - 1] + part.itemsize - places[first]).sum()) if len(first) else 0
    return {"values": part.n_values, "runs": len(first), "bytes": n, "amplification": n / max(1, part.n_values * part.itemsize)}
