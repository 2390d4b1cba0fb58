"""SimHash near-dedup by a generalised pigeonhole search.

Fingerprints within ``radius`` bits are found exactly: bits that vary together
are put into the same partition, every partition i gets its own threshold t_i
(-1: not probed) with sum(t_i) = radius - m + 1 for m partitions, chosen by
dynamic programming on candidate counts estimated from all fingerprints, and
each fingerprint probes partition i for values within t_i bits of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import connected_components, read, stored

BITS, BLOCK = 64, 8
#: Eight blocks of eight bits make the partitions of each scheme.
SCHEMES = ((4, 4), (3, 3, 2), (2, 2, 2, 2), (1,) * 8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; of the whole sequence if it has fewer words; empty if none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) < width:
        n, spans = 1, iter([(0, len(joined))])
    else:
        n = len(words) - width + 1
        spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), "<u8", n)


def simhash(text: str | None, width: int = 4) -> int:
    """Unsigned fingerprint of the word shingles of a text; 0 if it has no word."""
    hashes, set_bits = shingle_hashes(text, width), np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def simhash_udf(width: int = 4):  # noqa: ANN201
    @F.pandas_udf(LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([x - (1 << 64) if (x := simhash(t, width)) >> 63 else x for t in texts], dtype="int64")

    return fingerprint


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8)
    return np.unpackbits(values.reshape(-1, 8), axis=1, bitorder="little")


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros((BITS, BITS)), False
    for batch in batches:
        if batch.num_rows:
            bits, seen = _bits(batch).astype(np.float32), True
            total += bits.T @ bits
    if seen:
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(total.ravel().astype(np.int64))})


def group_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """Eight blocks of eight bits, correlated bits together: each block grows from the first free bit."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    free, blocks = list(range(BITS)), []
    while free:
        block = [free.pop(0)]
        while len(block) < BLOCK:
            best = max(free, key=lambda b: (phi[b, block].sum(), -b))
            free.remove(best)
            block.append(best)
        blocks.append(block)
    return blocks


def block_histograms(fps: DataFrame, blocks: list[list[int]]) -> np.ndarray:
    """Counts of the 256 values of every block over all fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 256), np.int64)
        for batch in batches:
            bits = _bits(batch)
            for k, block in enumerate(blocks):
                total[k] += np.bincount(np.packbits(bits[:, block], axis=1, bitorder="little")[:, 0], minlength=256)
        k, v = np.nonzero(total)
        if len(k):
            yield pa.RecordBatch.from_pydict({"i": pa.array(k, pa.int32()), "j": pa.array(v, pa.int32()), "n": pa.array(total[k, v])})

    out = np.zeros((len(blocks), 256))
    # At most 8 x 256 rows reach the driver.
    for i, j, n in fps.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    return out


def distance_shares(histogram: np.ndarray) -> np.ndarray:
    """Share of pairs at each distance 0..8 within one block."""
    values = np.arange(256)
    apart, p = np.bitwise_count(values[:, None] ^ values[None, :]), histogram / max(1, histogram.sum())
    return np.bincount(apart.ravel(), weights=np.outer(p, p).ravel(), minlength=BLOCK + 1)


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each partition, of the given sum and least cost: dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, more in cost.items():
                if spent + t not in step or c + more < step[spent + t][0]:
                    step[spent + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def plan_probes(fps: DataFrame, radius: int) -> list[tuple[int, int, list[int]]]:
    """(bit mask, threshold, bits) of the partitions to probe, from counts over all fingerprints."""
    both = np.zeros((BITS, BITS))
    # 64 x 64 rows reach the driver.
    for i, j, n in fps.select("fp").mapInArrow(_cooccurrence, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = n
    n = fps.count()
    if not n:
        return []
    blocks = group_bits(both, n)
    shares = [distance_shares(h) for h in block_histograms(fps, blocks)]
    found: tuple[float, list] | None = None
    for scheme in SCHEMES:
        parts, costs, at = [], [], 0
        for size in scheme:
            share = np.ones(1)
            for s in shares[at : at + size]:
                share = np.convolve(share, s)
            bits = sorted(itertools.chain(*blocks[at : at + size]))
            at += size
            parts.append(bits)
            costs.append({-1: 0.0} | {t: n * n / 2 * share[: t + 1].sum() + 4 * n * (1 + sum(math.comb(len(bits), d) for d in range(t + 1))) for t in range(min(radius, 2) + 1)})
        try:
            cost, chosen = allocate(costs, radius - len(scheme) + 1)
        except KeyError:
            continue
        if found is None or cost < found[0]:
            found = cost, [(sum(1 << b for b in bits), t, bits) for bits, t in zip(parts, chosen, strict=True) if t >= 0]
    assert found is not None
    return found[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (src, dst), src < dst, of distinct fingerprints at most ``radius`` bits apart; fps has fp, all distinct."""
    spark = fps.sparkSession
    links = None
    for mask, threshold, bits in plan_probes(fps, radius):
        flips = [_signed(sum(1 << b for b in some)) for d in range(threshold + 1) for some in itertools.combinations(bits, d)]
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        held = fps.select(F.col("fp").alias("src"), key.alias("key"))
        probe = fps.select(F.col("fp").alias("dst"), F.explode(F.array(*map(F.lit, flips))).alias("flip"), key.alias("own")).select("dst", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
        near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
        found = held.join(probe, (held["key"] == probe["key"]) & near).select("src", "dst")
        links = found if links is None else links.unionByName(found)
    return spark.createDataFrame([], "src long, dst long") if links is None else links


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Null and empty texts have fingerprint 0 and link like any other; equal
    fingerprints always link. Rows without doc_id get the component of their
    fingerprint but never name one; a component of such rows only is null.
    Repeated rows are returned as often as they come, other columns are ignored,
    and an empty table gives no rows.
    """
    marked = stored(docs.select("doc_id", simhash_udf(width)("text").alias("fp")), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    nodes = connected_components(link_fingerprints(fps, radius))
    named = fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(ids, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
