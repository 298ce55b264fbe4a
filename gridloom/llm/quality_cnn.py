"""Quality by a byte-level convolutional network in numpy.

A filter of ``width`` bytes is a table of weights by place and byte value. Its responses to the windows
of a text are sums of table look-ups; there is a window for every byte of the text, the last ones
reaching into ``width - 1`` zeros behind it. Windows are cut into groups of ``chunk`` starts; the bytes
of a group overlap those of the next by width - 1, so every window, and every byte, is covered. In a
chunk each filter keeps its largest response (max-pooling, after a rectifier). A document's vector holds
the mean and the maximum over its chunks, and one logistic unit combines it into a probability. Filters
and unit are learnt together by gradient descent; through max-pooling, a filter's gradient reaches only
the window that won.

Texts are worked on together, but nothing of one text enters the score of another, down to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fold, labelled_sample, slices

_STEP_BYTES = 1 << 19


@dataclass(frozen=True)
class CnnModel:
    table: np.ndarray  # width x 256 x filters, float32
    bias: np.ndarray  # of each filter
    unit: np.ndarray  # weights of the mean, then the maximum, of each filter
    base: float
    chunk: int = 256


def _responses(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Responses of the filters (windows x filters)."""
    n = len(data) - len(table) + 1
    out = table[0][data[:n]]
    for k in range(1, len(table)):
        out += table[k][data[k:k + n]]
    return out


def _windows(texts: list[bytes], table: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with width - 1 zeros after each text (an empty text is one zero byte), responses (none at
    those zeros), first window of each chunk, and the chunk's text."""
    pad = len(table) - 1
    sizes = np.array([max(1, len(t)) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + pad)[:-1]])
    data = np.frombuffer(b"".join((t or b"\0") + bytes(pad) for t in texts), dtype=np.uint8)
    responses = _responses(data, table)
    between = ((begins + sizes)[:-1, None] + np.arange(pad)).ravel()
    responses[between] = -np.inf
    counts = -(-sizes // chunk)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, responses, begins[owner] + within * chunk, owner


def _vectors(pooled: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean and maximum over the chunks of each document."""
    pooled = pooled.astype(np.float64)
    first = np.searchsorted(owner, np.arange(n))
    count = np.bincount(owner, minlength=n)[:, None]
    return np.concatenate([np.add.reduceat(pooled, first, axis=0) / count, np.maximum.reduceat(pooled, first, axis=0)], axis=1)


def _probability(x: np.ndarray, unit: np.ndarray, base: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((x * unit).sum(axis=1) + base, -30, 30)))


def gradients(texts: list[bytes], y: np.ndarray, model: CnnModel) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the texts' labels, and its gradient by parameter."""
    m, n = len(model.bias), len(texts)
    data, responses, starts, owner = _windows(texts, model.table, model.chunk)
    ends = np.concatenate([starts[1:], [len(responses)]])
    won = np.stack([a + responses[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
    raw = np.take_along_axis(responses, won, axis=0) + model.bias
    pooled = np.maximum(raw, 0)
    x = _vectors(pooled, owner, n)
    p = _probability(x, model.unit, model.base)
    loss = float(-np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-12)))
    error = (p - y) / n
    back = error[:, None] * model.unit[None, :]
    count = np.bincount(owner, minlength=n)
    top = pooled == x[owner, m:]
    ties = np.add.reduceat(top.astype(float), np.searchsorted(owner, np.arange(n)), axis=0)
    g = back[owner, :m] / count[owner][:, None] + back[owner, m:] * top / ties[owner]
    g = g * (raw > 0)
    table = np.zeros_like(model.table)
    column = np.broadcast_to(np.arange(m), won.shape)
    for j in range(len(table)):
        np.add.at(table[j], (data[won + j], column), g.astype(table.dtype))
    return loss, {"table": table, "bias": g.sum(axis=0), "unit": error @ x, "base": error.sum()}


def train(texts: list[bytes], y: np.ndarray, filters: int = 12, width: int = 5, chunk: int = 256, epochs: int = 8, least_steps: int = 400, seed: int = 5) -> CnnModel:
    """Fit filters and unit to texts and their labels (1: good), in ``epochs`` passes or as many as give
    ``least_steps`` steps of 32 texts. Without texts, or with one label alone, the model is a constant."""
    r = np.random.default_rng(seed)
    table = (r.standard_normal((width, 256, filters)) * 0.15).astype(np.float32)
    if not len(texts) or y.min() == y.max():
        p = 0.5 if not len(texts) else float(np.clip(y.mean(), 0.01, 0.99))
        return CnnModel(table, np.zeros(filters, np.float32), np.zeros(2 * filters), float(np.log(p / (1 - p))), chunk)
    unit = np.concatenate([r.standard_normal(filters) * 0.3, np.zeros(filters)])
    now = {"table": table, "bias": np.zeros(filters, dtype=np.float32), "unit": unit, "base": np.log(y.mean() / (1 - y.mean()))}
    moments = {name: [0.0, 0.0] for name in now}
    epochs = max(epochs, -(-least_steps * 32 // len(texts)))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        rate = 0.02 if epoch < epochs * 3 // 4 else 0.005
        for lo in range(0, len(order), 32):
            some = order[lo:lo + 32]
            step += 1
            _, slope = gradients([texts[i] for i in some], y[some], CnnModel(now["table"], now["bias"], now["unit"], float(now["base"]), chunk))
            slope["unit"] = slope["unit"] + 1e-4 * now["unit"]
            for name, g in slope.items():
                a, b = moments[name]
                a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
                moments[name] = [a, b]
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
                now[name] = (now[name] - move).astype(np.float32) if name in ("table", "bias") else now[name] - move
    return CnnModel(now["table"], now["bias"], now["unit"], float(now["base"]), chunk)


def probabilities(texts: list[bytes], model: CnnModel) -> np.ndarray:
    """Probability that each text is good; memory is bounded by the longest text or a fixed step."""
    out, at = [], 0
    while at < len(texts):
        hi, size = at, 0
        while hi < len(texts) and (hi == at or size + len(texts[hi]) <= _STEP_BYTES):
            size += len(texts[hi])
            hi += 1
        if hi == at + 1:
            pooled = _long(texts[at] or b"\0", model)
            owner = np.zeros(len(pooled), dtype=np.int64)
        else:
            _, responses, starts, owner = _windows(texts[at:hi], model.table, model.chunk)
            pooled = np.maximum(np.maximum.reduceat(responses, starts, axis=0) + model.bias, 0)
        out.append(_probability(_vectors(pooled, owner, hi - at), model.unit, model.base))
        at = hi
    return np.concatenate(out) if out else np.zeros(0)


def _long(text: bytes, model: CnnModel) -> np.ndarray:
    """Chunk vectors of one text, a bounded stretch at a time."""
    stretch, pad = max(1, _STEP_BYTES // model.chunk) * model.chunk, len(model.table) - 1
    parts = []
    for a in range(0, len(text), stretch):
        # Windows that start in the stretch; their bytes reach into the next one.
        n = min(stretch, len(text) - a)
        data = np.frombuffer(text[a:a + n + pad].ljust(n + pad, b"\0"), dtype=np.uint8)
        top = np.maximum.reduceat(_responses(data, model.table), np.arange(0, n, model.chunk), axis=0)
        parts.append(np.maximum(top + model.bias, 0))
    return np.concatenate(parts)


def score(docs: DataFrame, model: CnnModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier good) of every row, from all bytes of its text.

    A null text counts as empty; an empty text is one chunk of a zero byte and has a score too. Null
    and repeated ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            got = probabilities([(t or "").encode("utf-8", "surrogatepass") for t in some.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_pydict({"doc_id": some.column(0), "score": pa.array(got, pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def learnt(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 10_000) -> CnnModel:
    """A model from a bounded sample: at most ``sample_rows`` labelled documents of at most
    ``sample_chars`` characters outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", sample_rows, sample_chars).select("text", "label").collect()
    return train([r[0].encode("utf-8", "surrogatepass") for r in rows], np.array([int(r[1] != 0) for r in rows]))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learnt(docs, labels)).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
