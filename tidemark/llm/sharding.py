"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row number r goes to place p = permute(r); its shard is p mod shards, its slot
p div shards. Shards hold equally many rows, at most one apart, and a row's
shard and slot, or the row at a shard and slot, can be computed from the key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import number_rows, read

SHARDS, KEY, ROUNDS = 40, 20240229, 6


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of SplitMix64; its three numbers are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _round_keys(key: int, rounds: int) -> list[np.uint64]:
    return [np.uint64(x) for x in _mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))]


def _half_bits(n: int) -> int:
    """Half the bits of the least even-width domain that holds 0..n-1; under 4 n in size."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1 applied to numbers: Feistel rounds, walked until the value is below n."""
    half = np.uint64(_half_bits(n))
    low, keys = np.uint64((1 << int(half)) - 1), _round_keys(key, rounds)
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & low
        for k in keys:
            left, right = right, left ^ (_mixed(right + k) & low)
        out[walk] = left << half | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def unpermute(places: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The inverse of permute."""
    half = np.uint64(_half_bits(n))
    low, keys = np.uint64((1 << int(half)) - 1), _round_keys(key, rounds)
    out = places.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & low
        for k in reversed(keys):
            left, right = right ^ (_mixed(left + k) & low), left
        out[walk] = left << half | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text).

    Rows are numbered by doc_id, nulls first, ties by text hash; the law is
    ``rows``. A null text has size 16 and a null text_crc32; repeated rows have
    a number each; an empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("_tie"))
    numbered = number_rows(slim, ["doc_id", "_tie"])
    n = numbered.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(np.int64), n, key))

    placed = numbered.withColumn("_place", place("row_number"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
