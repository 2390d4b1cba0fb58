"""Quality classifier: a factorisation machine.

Features are hashed words (log counts, unit length), statistics of the text's
structure and its recorded length. Pairs interact through low-rank factors, and
a score takes time linear in the features: half of (sum of v x) squared less
the sum of (v x) squared.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, widened
from tidemark.llm.samples import labelled

BUCKETS, RANK, KEEP, SAMPLE = 4096, 8, 0.3, 4000
STATS = 16
_KINDS = np.zeros(256, np.int64)  # of UTF-8 bytes: 0 rest, 1 upper, 2 lower, 3 digit, 4 space, 5 line end, 6 symbol, 7 not ASCII
for _c in range(256):
    _KINDS[_c] = 7 if _c > 127 else 5 if _c == 10 else 4 if chr(_c).isspace() else 3 if chr(_c).isdigit() else 1 if chr(_c).isupper() else 2 if chr(_c).islower() else 6 if _c > 32 else 0


@functools.lru_cache(1 << 18)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    counts, lines = Counter(words), Counter(text.split("\n"))
    kinds = np.zeros(8)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for start in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_KINDS[raw[start : start + (1 << 20)]], minlength=8)
    n, w = max(1, len(raw)), max(1, len(words))
    ends = Counter(map(lambda x: x[-1], counts))  # noqa: C417
    odd = sum(c for e, c in ends.items() if not (e.isalnum() or e in ".,;:?\"')"))
    stats = np.array([
        *(kinds[1:] / n), np.log1p(len(words)), len(text) / w / 10, len(counts) / w, max(counts.values(), default=0) / w,
        1 - len(lines) / max(1, sum(lines.values())), odd / max(1, len(counts)), (counts["|"] + counts["-"]) / w, len(words) / max(1, sum(lines.values())) / 50,
        np.log1p(len(text) if n_chars is None or n_chars < 0 else n_chars),
    ])
    buckets = np.fromiter(map(_bucket, counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return buckets, values / max(1e-9, float(np.sqrt(values @ values))), stats


@dataclass(frozen=True)
class Machine:
    """A fitted factorisation machine; without ``weights`` every score is ``prior``."""

    prior: float
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 4

    def score(self, text: str | None, n_chars: int | None) -> float:
        if self.weights is None:
            return self.prior
        buckets, values, stats = features(text, n_chars)
        at = np.concatenate([buckets, np.arange(BUCKETS, BUCKETS + STATS + 1)])
        x = np.concatenate([values, self.scaled(stats), [1.0]])
        vx = self.factors[at] * x[:, None]
        total = vx.sum(axis=0)
        y = self.weights[at] @ x + 0.5 * float(total @ total - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(rows: pd.DataFrame, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> Machine:
    """A machine fitted by Adam to rows (buckets, values, stats, label); the prior alone if a class has no row."""
    y = rows["label"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return Machine(float(y.mean()) if len(y) else 0.5)
    stats = np.stack(rows["stats"].to_list())
    machine = Machine(float(y.mean()), np.zeros(BUCKETS + STATS + 1), None, stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6))
    rng, size = np.random.default_rng(seed), BUCKETS + STATS + 1
    w, v = np.zeros(size), 0.05 * rng.standard_normal((size, RANK))
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, v)], 0
    scaled, buckets, values = machine.scaled(stats), rows["buckets"].to_list(), rows["values"].to_list()
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows_at in np.split(order, range(batch, len(y), batch)):
            x = np.zeros((len(rows_at), size))
            for k, r in enumerate(rows_at):
                np.add.at(x[k], buckets[r], values[r])
            x[:, BUCKETS:-1], x[:, -1] = scaled[rows_at], 1
            inner, square = x @ v, x * x
            out = x @ w + 0.5 * ((inner**2).sum(axis=1) - (square @ (v * v)).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows_at]) / len(rows_at)
            slopes = (x.T @ error + decay * w, x.T @ (error[:, None] * inner) - (square.T @ error)[:, None] * v + decay * v)
            step += 1
            for p, g, (m, s) in zip((w, v), slopes, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(machine.prior, w, v, machine.mean, machine.spread)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine learned from about ``sample`` labelled rows a class of docs (doc_id, text, n_chars)."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                found = [features(t, None if pd.isna(n) else int(n)) for t, n in zip(rows["text"], rows["n_chars"], strict=True)]
                yield pd.DataFrame({"buckets": [b for b, _, _ in found], "values": [v for _, v, _ in found], "stats": [s for _, _, s in found], "label": rows["label"].to_numpy()})

    rows = labelled(docs, labels, "quality", 5, 0, sample).mapInPandas(extract, "buckets array<long>, values array<double>, stats array<double>, label int")
    # The bounded sample's features reach the driver.
    return fit(rows.toPandas())


def score(docs: DataFrame, machine: Machine, keep: float = KEEP, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted (1 if score >= keep) under the given names; they replace columns so named.

    Null texts count as empty and get the score that the empty text has; n_chars
    that is null or missing is counted from the text. Repeated rows score alike.
    """
    held = docs.drop(*names)
    columns = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n_chars").to_pylist() if "n_chars" in columns else [None] * batch.num_rows
            found = [machine.score(t.as_py(), n) for t, n in zip(batch.column("text"), lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= keep) for s in found], pa.int32())], [*columns, *names])

    return held.mapInArrow(run, widened(held, f"{names[0]} double, {names[1]} int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = learn(docs, read(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")
