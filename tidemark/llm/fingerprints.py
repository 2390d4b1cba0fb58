"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line that isn't empty) hashes to a wide vector modulo 2**32 and
a document's fingerprint is the sum of its paragraphs' vectors. So the order of
paragraphs doesn't matter, and inserting or deleting one is an addition or a
subtraction. The first EXACT lanes of a paragraph's vector are its digest: sums
of these decide equality. The other LANES lanes count its windows of WINDOW code
points, each as +1 or -1 in one lane: the cosine of two such sums estimates how
much of the text is shared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, read

EXACT, LANES, WINDOW = 8, 256, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)]


def _windows(line: np.ndarray) -> np.ndarray:
    """Hashes of all windows of code points; a shorter line is one window."""
    width = min(WINDOW, len(line))
    h = np.zeros(len(line) - width + 1, np.uint64)
    for k in range(width):
        h += line[k : len(h) + k] * np.uint64(_POWERS[k])
    h ^= h >> np.uint64(29)
    h *= _STEP
    return h ^ (h >> np.uint64(32))


def vector(text: str | None) -> np.ndarray:
    """The fingerprint of a text as EXACT + LANES unsigned lanes."""
    out = np.zeros(EXACT + LANES, np.uint32)
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    breaks = np.flatnonzero(codes == 11)
    for line in text.split("\n"):
        if line:
            out[:EXACT] += np.frombuffer(hashlib.blake2b(line.encode(), digest_size=4 * EXACT).digest(), "<u4")
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    short = (ends - starts < WINDOW) & (ends > starts)
    hashes = [_windows(codes[a:b]) for a, b in zip(starts[short], ends[short], strict=True)]
    if len(codes) >= WINDOW:
        whole = np.ones(len(codes) - WINDOW + 1, bool)  # windows within one line
        for b in breaks:
            whole[max(0, b - WINDOW + 1) : b + 1] = False
        hashes.append(_windows(codes)[whole])
    for h in hashes:
        lane, sign = (h >> np.uint64(40)).astype(np.int64) % LANES, 1 - 2 * (h & np.uint64(1)).astype(np.int64)
        out[EXACT:] += np.bincount(lane, sign, LANES).astype(np.int64).astype(np.uint32)
    return out


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of two documents' paragraphs together."""
    return a + b


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of a without the paragraphs of b."""
    return a - b


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints, about 0 for texts that share nothing."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].view(np.int32).astype(np.float64) for v in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / size))) if size else 0.0


def encode(v: np.ndarray) -> str:
    return base64.b64encode(v.astype("<u4").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4").copy()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, halo, id): each row of a block meets its successor; the halo row ends the block."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows: list[tuple] = []
    held = None  # (block, doc_id, text, vector)

    def close(held: tuple, text: str, following: np.ndarray) -> tuple:
        _, doc_id, before, own = held
        cut = len(before) // 4
        edited = before[: len(before) - cut] + text[:cut]
        changed = vector(edited) if cut else own
        return doc_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), encode(own), encode(changed), likeness(own, changed), likeness(own, following)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names)
        rows.clear()
        return batch

    ended = None  # block whose halo has been seen
    for batch in batches:
        for block, halo, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if block == ended:
                continue  # further rows that tie with the halo row
            text = text or ""
            own = vector(text)
            if held is not None and held[0] == block:
                rows.append(close(held, text, own))
            held, ended = (None, block) if halo else ((block, doc_id, text, own), None)
            if len(rows) >= 500:
                yield flush()
    if rows:
        yield flush()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text) and of its edit with the next document.

    Documents follow each other by doc_id, nulls first, ties by text hash; the
    last is followed by the first. A null text counts as empty; an empty text
    has the zero fingerprint and likeness 1 to another empty one, 0 to any other.
    Repeated rows follow each other. A lone document is its own successor. An
    empty table gives no rows; other columns are ignored.

    Ids split into blocks at quantiles of all ids. A document that begins a
    block is also sent to the block before it, so one shuffle of the texts brings
    neighbours together and each task streams its block in order.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    keyed = docs.select(F.coalesce("doc_id", F.lit(low)).alias("key"), "doc_id", "text")
    shares = [k / partitions(spark) for k in range(1, partitions(spark))]
    # One id a partition, and the least, reach the driver.
    least, cuts = keyed.agg(F.min("key"), F.percentile_approx("key", shares, 20_000) if shares else F.lit(None)).first()
    cuts = sorted({c for c in cuts or [] if c > least}) if least is not None else []
    marks = F.array(*map(F.lit, cuts)) if cuts else F.lit(None).cast("array<long>")

    def block(keys: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(cuts, np.int64)
        for batch in keys:
            at = np.searchsorted(bounds, batch.column("key").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "block"])

    placed = keyed.mapInArrow(block, "key long, doc_id long, text string, block int")
    own = F.struct(F.col("block"), F.lit(0).alias("halo"))
    to_last = F.when(F.col("key") == F.lit(least), F.struct(F.lit(len(cuts)).alias("block"), F.lit(1).alias("halo")))
    to_previous = F.when(F.array_contains(marks, F.col("key")), F.struct((F.col("block") - 1).alias("block"), F.lit(1).alias("halo")))
    sent = placed.withColumn("at", F.explode(F.array_compact(F.array(own, to_last, to_previous))))
    sent = sent.select("at.block", "at.halo", "doc_id", "text", "key", F.xxhash64("text").alias("tie"))
    there = sent.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("block", "halo", "key", "tie")
    return there.select("block", "halo", "doc_id", "text").mapInArrow(_consecutive, SCHEMA)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))
