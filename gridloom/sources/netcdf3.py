"""Classic NetCDF files (versions 1, 2 and 5) as a Spark data source, and a small writer.

The header is read on the driver. A scan reads what is asked for: positions of each axis, or points that
pair two of them, and what Spark's filters leave of these. It is split by variable and into blocks of
bounded size along any dimension; each task opens the file, reads its block's byte runs (see ``hyperslab``)
and emits Arrow batches of positions and raw values. The file must be reachable under one path by all
executors; its size, time stamp and header are checked in every task, so a file that changes is an error
and never a mix.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.errors import GridError, require
from gridloom.sources import hyperslab

# Type codes of the format.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {v: k for k, v in TYPES.items()}
#: Values of an Arrow batch and of a task: a task's block has 32 MB of doubles at most.
BATCH, BLOCK = 262_144, 4_194_304


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    attributes: dict
    dtype: str
    begin: int
    record: bool


@dataclass(frozen=True)
class Header:
    path: str
    size: int
    modified: int
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    record_bytes: int
    head_bytes: int = 0
    head_sha256: str = ""


def local(path: str) -> str:
    require("://" not in path or path.startswith("file://"), "netcdf_file_error", "only files under a mounted path are read")
    return path.removeprefix("file://")


def read_header(path: str) -> Header:
    """Dimensions, attributes and variables of a file."""
    path = local(path)
    if not os.path.isfile(path):
        raise GridError("netcdf_file_error", f"{path} is no file")
    stat = os.stat(path)
    with open(path, "rb") as f:
        data = f.read(min(stat.st_size, 16 << 20))
    require(data[:3] == b"CDF" and data[3] in (1, 2, 5), "netcdf_file_error", "not a classic NetCDF file (HDF5-based files are not supported)")
    wide, at = data[3] == 5, 4

    def number(big: bool) -> int:
        nonlocal at
        at += 8 if big else 4
        return struct.unpack(">q" if big else ">i", data[at - (8 if big else 4):at])[0]

    def text() -> str:
        nonlocal at
        n = number(wide)
        out = data[at:at + n].decode()
        at += -(-n // 4) * 4
        return out

    def attributes() -> dict:
        nonlocal at
        number(False)
        out = {}
        for _ in range(number(wide)):
            name = text()
            kind, n = TYPES[number(False)], number(wide)
            size = n * np.dtype(kind).itemsize
            raw, at = data[at:at + size], at + -(-size // 4) * 4
            values = np.frombuffer(raw, kind)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else values.item() if n == 1 else values.tolist()
        return out

    records = number(wide)
    number(False)
    dims = [(text(), number(wide)) for _ in range(number(wide))]
    sizes = {name: records if n == 0 else n for name, n in dims}
    unlimited = {name for name, n in dims if n == 0}
    told = attributes()
    number(False)
    variables, record_bytes = {}, 0
    for _ in range(number(wide)):
        name = text()
        own = tuple(dims[number(wide)][0] for _ in range(number(wide)))
        attrs, kind, size, begin = attributes(), TYPES[number(False)], number(wide), number(data[3] != 1)
        record = bool(own) and own[0] in unlimited
        record_bytes += size if record else 0
        variables[name] = Variable(name, own, tuple(sizes[d] for d in own), attrs, kind, begin, record)
    only = [v for v in variables.values() if v.record]
    if len(only) == 1:  # a single record variable is not padded
        record_bytes = int(np.prod(only[0].shape[1:], dtype=np.int64)) * np.dtype(only[0].dtype).itemsize
    return Header(path, stat.st_size, int(stat.st_mtime_ns), sizes, told, variables, record_bytes, at, hashlib.sha256(data[:at]).hexdigest())


def opened(header: Header):
    """The file, if it is still the one whose header was read."""
    require(os.path.isfile(header.path), "netcdf_read_error", f"{header.path} is gone")
    stat = os.stat(header.path)
    file = open(header.path, "rb")
    try:
        same = hashlib.sha256(file.read(header.head_bytes)).hexdigest() == header.head_sha256
        require(same, "netcdf_schema_changed", f"dimensions, variables or attributes of {header.path} changed since it was opened")
        require((stat.st_size, int(stat.st_mtime_ns)) == (header.size, header.modified), "netcdf_changed_file", f"{header.path} changed since it was opened")
    except Exception:
        file.close()
        raise
    return file


def strides(header: Header, v: Variable) -> tuple[int, ...]:
    """Bytes from one position to the next, by dimension."""
    out, size = [], np.dtype(v.dtype).itemsize
    for n in reversed(v.shape):
        out.append(size)
        size *= n
    out.reverse()
    if v.record:
        out[0] = header.record_bytes
    return tuple(out)


def slab_of(header: Header, v: Variable, wanted: list[np.ndarray] | None = None, paired: tuple[int, int] | None = None) -> hyperslab.Slab:
    """The slab of a variable at positions of each dimension (all of them, if not given)."""
    wanted = [np.arange(n) for n in v.shape] if wanted is None else wanted
    for d, (p, n) in enumerate(zip(wanted, v.shape)):
        require(not len(p) or (min(p) >= 0 and max(p) < n), "bad_block", f"{v.name}: positions of dimension {d} lie outside 0 to {n - 1}")
    return hyperslab.slab(v.begin, np.dtype(v.dtype).itemsize, strides(header, v), wanted, paired)


def values(header: Header, name: str) -> np.ndarray:
    """A whole small variable, such as an axis."""
    v = header.variables[name]
    with opened(header) as file:
        return hyperslab.read(file, slab_of(header, v), v.dtype).reshape(v.shape)


def in_runs(positions) -> list[list[int]]:
    """Ascending positions as [first, last, step] runs: the form in which options carry them."""
    p, out, at = [int(x) for x in positions], [], 0
    while at < len(p):
        end = at + 1
        step = p[end] - p[at] if end < len(p) else 1
        while end < len(p) and p[end] - p[end - 1] == step:
            end += 1
        out.append([p[at], p[end - 1], max(1, step)])
        at = end
    return out


class _Block(InputPartition):
    def __init__(self, name: str, slab: hyperslab.Slab):
        self.name, self.slab = name, slab


class _Reader(DataSourceReader):
    """Options: path, variables, roles, and what to read: ``wanted`` (JSON: runs of positions by role) and
    ``points`` (JSON: pairs of lon_idx and lat_idx)."""

    def __init__(self, options: dict):
        self.header = read_header(options["path"])
        self.names = options["variables"].split(",")
        #: For each variable, which of lon_idx, lat_idx, depth_idx, time_idx each of its dimensions is.
        self.roles = [r.split("/") for r in options["roles"].split(",")]
        self.gap = int(options.get("gap", hyperslab.GAP))
        asked = json.loads(options.get("wanted", "{}"))
        self.wanted = {role: np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(a, b + 1, s) for a, b, s in runs)])) for role, runs in asked.items()}
        points = json.loads(options["points"]) if "points" in options else None
        self.points = None if points is None else np.unique(np.array(points, dtype=np.int64).reshape(-1, 2), axis=0)

    def slab(self, name: str, roles: list[str]) -> hyperslab.Slab:
        """What to read of a variable."""
        v = self.header.variables[name]
        asked = [self.wanted.get(role, np.arange(n)) for role, n in zip(roles, v.shape)]
        if self.points is None:
            return slab_of(self.header, v, asked)
        lon, lat = roles.index("lon_idx"), roles.index("lat_idx")
        some = self.points[np.isin(self.points[:, 0], asked[lon]) & np.isin(self.points[:, 1], asked[lat])]
        asked[lon], asked[lat] = some[:, 0], some[:, 1]
        return slab_of(self.header, v, asked, (lon, lat))

    def partitions(self) -> list[_Block]:
        return [_Block(name, part) for name, roles in zip(self.names, self.roles) for part in self.slab(name, roles).blocks(BLOCK)]

    def read(self, part: _Block) -> Iterator:
        import pyarrow as pa

        v, roles = self.header.variables[part.name], self.roles[self.names.index(part.name)]
        with opened(self.header) as file:
            for some in part.slab.blocks(BATCH):
                raw = hyperslab.read(file, some, v.dtype, self.gap).astype("<f8")
                columns = {c: some.at(roles.index(c)).astype(np.int32) if c in roles else np.zeros(len(raw), np.int32) for c in ("lon_idx", "lat_idx", "depth_idx", "time_idx")}
                yield pa.RecordBatch.from_pydict(
                    {c: pa.array(x, pa.int32()) for c, x in columns.items()} | {"variable": pa.array([part.name] * len(raw), pa.string()), "raw": pa.array(raw, pa.float64())})


class _PushedReader(_Reader):
    """A reader that only reads the positions that filters leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        sizes = {role: n for name, roles in zip(self.names, self.roles) for role, n in zip(roles, self.header.variables[name].shape)}
        for f in filters:
            role = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if role in sizes:
                p = self.wanted.get(role, np.arange(sizes[role]))
                if isinstance(f, EqualTo):
                    p = p[p == f.value]
                elif isinstance(f, In):
                    p = p[np.isin(p, [x for x in f.value if x is not None])]
                elif isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                    p = p[p >= f.value + isinstance(f, GreaterThan)]
                elif isinstance(f, (LessThanOrEqual, LessThan)):
                    p = p[p <= f.value - isinstance(f, LessThan)]
                self.wanted[role] = p
            elif role == "variable" and isinstance(f, (EqualTo, In)):
                keep = [k for k, n in enumerate(self.names) if n in ([f.value] if isinstance(f, EqualTo) else f.value)]
                self.names, self.roles = [self.names[k] for k in keep], [self.roles[k] for k in keep]
            yield f  # Spark still tests each row


class NetCdfSource(DataSource):
    """``spark.read.format("netcdf3")`` with options path, variables, roles, wanted and points. With the option
    pushdown (and Spark's ``spark.sql.python.filterPushdown.enabled``, without which it is an error) filters
    on positions and variables bound what is read, too."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        return "lon_idx int, lat_idx int, depth_idx int, time_idx int, variable string, raw double"

    def reader(self, schema) -> _Reader:
        return (_PushedReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))


def layout(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.dtype, dict]], attributes: dict | None = None) -> tuple[bytes, dict[str, int], int]:
    """Header of a classic file (64-bit offsets, fixed dimensions), where each variable begins, and the file's size."""
    names = list(dims)

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw + bytes(-len(raw) % 4)

    def told(attrs: dict) -> bytes:
        if not attrs:
            return bytes(8)
        out = struct.pack(">ii", 12, len(attrs))
        for k, v in attrs.items():
            if isinstance(v, str):
                raw, code, n = v.encode(), 2, len(v.encode())
            else:
                array = np.atleast_1d(np.asarray(v))
                kind = array.dtype.newbyteorder(">").str
                raw, code, n = array.astype(kind).tobytes(), CODES[kind if kind in CODES else ">f8"], array.size
            out += text(k) + struct.pack(">ii", code, n) + raw + bytes(-len(raw) % 4)
        return out

    sizes = {k: math.ceil(math.prod(dims[d] for d in own) * kind.itemsize / 4) * 4 for k, (own, kind, _) in variables.items()}
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(names)) + b"".join(text(d) + struct.pack(">i", n) for d, n in dims.items()) + told(attributes or {})

    def listed(begins: dict[str, int]) -> bytes:
        out = struct.pack(">ii", 11, len(variables))
        for k, (own, kind, attrs) in variables.items():
            code = ">i1" if kind == np.int8 else "S1" if kind.kind == "S" else kind.newbyteorder(">").str
            out += text(k) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", names.index(d)) for d in own) + told(attrs)
            out += struct.pack(">iiq", CODES[code], min(sizes[k], 2**31 - 4), begins[k])  # the size field does not bind
        return out

    at = len(head) + len(listed(dict.fromkeys(variables, 0)))
    begins = {}
    for k, n in sizes.items():
        begins[k] = at
        at += n
    return head + listed(begins), begins, at


def write(path: str, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray | np.dtype, dict]], attributes: dict | None = None) -> dict[str, int]:
    """Write a classic file and say where its variables begin. A variable given by its type alone gets its
    place, and its values from whoever writes them there."""
    require(all(not isinstance(a, np.ndarray) or a.shape == tuple(dims[d] for d in own) for own, a, _ in variables.values()), "netcdf_file_error", "a variable has another shape than its dimensions")
    kinds = {k: (own, a.dtype if isinstance(a, np.ndarray) else np.dtype(a), attrs) for k, (own, a, attrs) in variables.items()}
    head, begins, size = layout(dims, kinds, attributes)
    with open(local(path), "wb") as f:
        f.write(head)
        f.truncate(size)
        for k, (_, a, _) in variables.items():
            if isinstance(a, np.ndarray):
                f.seek(begins[k])
                f.write(np.ascontiguousarray(a, a.dtype.newbyteorder(">")).tobytes())
    return begins
