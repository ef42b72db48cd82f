"""Quality of a text by a byte-level convolutional network in numpy.

The bytes of a document are cut into overlapping chunks that cover all of it. In each chunk,
learned filters over embedded bytes slide along in half-overlapping steps, and each filter's largest answer in
the chunk is kept. A small layer combines these, the largest answers of its units over all
chunks are kept again, together with their means, and combined into one probability.

Training takes a bounded sample: `sample` labelled documents, those whose ids hash lowest, and
`chunks` chunks of each, evenly spaced. Scoring reads every byte of every document.
A null text is an empty one; it has one chunk without bytes. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import text

ADDED = "score double"
#: A text is good from this score on.
THRESHOLD = 0.3


@dataclass(frozen=True)
class Shape:
    """Sizes of the network. `overlap` bytes of a chunk stand in the next one as well."""

    chunk: int = 160
    overlap: int = 32
    width: int = 8
    stride: int = 4
    embed: int = 4
    filters: int = 24
    hidden: int = 12


@dataclass(frozen=True)
class Training:
    """Bounds and steps of the fit; `sample` documents and `chunks` chunks of each at most."""

    sample: int = 3000
    chunks: int = 12
    steps: int = 1200
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


def cut(offsets: np.ndarray, data: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and bytes (0 after the end, else byte + 1) of all chunks; one chunk at least for each text."""
    sizes = np.diff(offsets)
    step = shape.chunk - shape.overlap
    count = np.maximum(1, -(-np.maximum(sizes - shape.overlap, 1) // step))
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[:-1][owner] + number * step)[:, None] + np.arange(shape.chunk)
    inside = at < offsets[1:][owner][:, None]
    padded = np.append(data, 0)
    return owner, np.where(inside, padded[np.where(inside, at, len(data))].astype(np.int16) + 1, 0)


def _windows(embedded: np.ndarray, shape: Shape) -> np.ndarray:
    """All windows of the filters: chunks x positions x (width * embed)."""
    view = np.lib.stride_tricks.sliding_window_view(embedded, shape.width, axis=1)[:, :: shape.stride]
    return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(embedded), view.shape[1], -1)


class Network:
    """Weights and both directions of the network."""

    def __init__(self, shape: Shape, seed: int):
        random = np.random.default_rng(seed)
        s = shape
        self.shape = shape
        self.weights = {
            "embed": random.normal(0, 0.5, (257, s.embed)),
            "filter": random.normal(0, (s.width * s.embed) ** -0.5, (s.width * s.embed, s.filters)),
            "filter_bias": np.zeros(s.filters),
            "mix": random.normal(0, s.filters**-0.5, (s.filters, s.hidden)),
            "mix_bias": np.zeros(s.hidden),
            "out": random.normal(0, 0.1, 2 * s.hidden),
            "out_bias": np.zeros(1),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def pooled(self, chunks: np.ndarray, keep: bool = False):
        """Largest answer of each filter in each chunk."""
        w = self.weights
        windows = _windows(w["embed"][chunks], self.shape)
        answers = windows @ w["filter"]
        if keep:
            return windows, answers.argmax(axis=1), answers.max(axis=1) + w["filter_bias"]
        return answers.max(axis=1) + w["filter_bias"]

    def units(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.tanh(pooled) @ self.weights["mix"] + self.weights["mix_bias"], 0)

    def logits(self, units: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        starts = np.searchsorted(owner, np.arange(n))
        largest = np.maximum.reduceat(units, starts)
        mean = np.add.reduceat(units, starts) / np.bincount(owner, minlength=n)[:, None]
        return np.hstack([largest, mean]) @ self.weights["out"] + self.weights["out_bias"][0]

    def score(self, offsets: np.ndarray, data: np.ndarray, step: int = 256) -> np.ndarray:
        owner, chunks = cut(offsets, data, self.shape)
        units = np.concatenate([self.units(self.pooled(chunks[i : i + step])) for i in range(0, len(chunks), step)])
        return 1 / (1 + np.exp(-self.logits(units, owner, len(offsets) - 1).astype(np.float64)))

    def gradients(self, owner: np.ndarray, chunks: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of a few documents; owner is ascending from 0."""
        w, n = self.weights, len(labels)
        windows, where, pooled = self.pooled(chunks, keep=True)
        bent = np.tanh(pooled)
        units = np.maximum(bent @ w["mix"] + w["mix_bias"], 0)
        starts, count = np.searchsorted(owner, np.arange(n)), np.bincount(owner, minlength=n)
        largest = np.maximum.reduceat(units, starts)
        joined = np.hstack([largest, np.add.reduceat(units, starts) / count[:, None]])
        logits = joined @ w["out"] + w["out_bias"][0]
        error = (1 / (1 + np.exp(-logits)) - labels) / n
        by_unit = error[:, None] * w["out"]
        hidden = self.shape.hidden
        first = (units == largest[owner]) & (units > 0)
        d_units = (first * by_unit[owner, :hidden] + by_unit[owner, hidden:] / count[owner][:, None]) * (units > 0)
        d_pooled = (d_units @ w["mix"].T) * (1 - bent**2)
        rows = np.arange(len(chunks))[:, None]
        picked = windows[rows, where]  # chunks x filters x (width * embed)
        d_picked = d_pooled[:, :, None] * w["filter"].T
        bytes_ = chunks[rows[:, :, None], where[:, :, None] * self.shape.stride + np.arange(self.shape.width)]
        d_embed = np.zeros_like(w["embed"])
        np.add.at(d_embed, bytes_.reshape(-1), d_picked.reshape(-1, self.shape.embed))
        return {
            "embed": d_embed,
            "filter": np.einsum("cf,cfx->xf", d_pooled, picked),
            "filter_bias": d_pooled.sum(0),
            "mix": bent.T @ d_units,
            "mix_bias": d_units.sum(0),
            "out": joined.T @ error,
            "out_bias": np.array([error.sum()]),
        }


def fit(texts: list[bytes], labels: list[int], shape: Shape = Shape(), training: Training = Training()) -> Network:
    """Adam over shuffled documents; the same rows in the same order give the same network."""
    network = Network(shape, training.seed)
    if not texts:
        network.weights["out"][:] = 0
        return network
    random = np.random.default_rng(training.seed)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    owner, chunks = cut(offsets, np.frombuffer(b"".join(texts), np.uint8), shape)
    spans = np.searchsorted(owner, np.arange(len(texts) + 1))
    target = np.array(labels, np.float32)
    drift, mass = ({k: np.zeros_like(v) for k, v in network.weights.items()} for _ in range(2))
    order = np.zeros(0, int)
    for turn in range(1, training.steps + 1):
        if len(order) < training.batch:
            order = np.concatenate([order, random.permutation(len(texts))])
        rows, order = order[: training.batch], order[training.batch :]
        chosen = [np.unique(np.linspace(spans[i], spans[i + 1] - 1, training.chunks).round().astype(int)) for i in rows]
        own = np.repeat(np.arange(len(rows)), [len(x) for x in chosen])
        rate = training.rate * (1 - 0.9 * turn / training.steps)
        for k, g in network.gradients(own, chunks[np.concatenate(chosen)], target[rows]).items():
            drift[k] += 0.1 * (g - drift[k])
            mass[k] += 0.01 * (g * g - mass[k])
            network.weights[k] -= (rate * (drift[k] / (1 - 0.9**turn)) / (np.sqrt(mass[k] / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
    return network


def learn(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), training: Training = Training(), column: str = "text") -> Network:
    """Fit on a bounded sample of labelled documents; labels has doc_id and quality, docs doc_id and the text.

    Only the sample reaches the driver. Of a text, only `chunks` chunks are used, cut by the workers.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).dropna()
    order = (F.xxhash64("_id"), F.col("_id"), F.col("_label"))
    chosen = known.orderBy(*order).limit(training.sample)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(column).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.pieces(batches, "_text"):
            values = []
            for value in batch.column("_text").to_pylist():
                data = (value or "").encode()
                step = shape.chunk - shape.overlap
                n = max(1, -(-max(len(data) - shape.overlap, 1) // step))
                # Evenly spaced chunks; a text with more chunks keeps only these, one after the other.
                if n > training.chunks:
                    at = np.unique(np.linspace(0, n - 1, training.chunks).round().astype(int)).tolist()
                    data = b"".join(data[i * step : i * step + step] for i in at)
                values.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("_label"), pa.array(values, pa.binary())], names=["_id", "_label", "_data"])

    sample = rows.mapInArrow(run, "_id bigint, _label int, _data binary").limit(2 * training.sample).collect()
    sample = sorted((row["_id"], row["_label"], bytes(row["_data"])) for row in sample)
    return fit([row[2] for row in sample], [row[1] for row in sample], shape, training)


def score(docs: DataFrame, network: Network, column: str = "text") -> DataFrame:
    """docs with the probability that a text is good; the network is a few kilobytes and travels with the tasks."""

    def step(texts: pa.Array) -> list[pa.Array]:
        offsets, data = text.raw(pc.fill_null(texts, ""))
        return [pa.array(network.score(offsets, data))]

    return text.map_texts(docs, column, ADDED, step)
