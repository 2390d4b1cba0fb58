"""Importance resampling towards a target distribution over hashed n-grams.

Texts become word ids, pieces of a partition one array with gaps between texts.
A suffix array of it, sorted as deep as the longest n-gram, brings equal n-grams
together; runs of neighbours whose common prefix (LCP) has m words are the
repeats of one m-gram. Each run is hashed once, from the hash of its first m - 1
words, and its bucket scattered back to where it occurs. One pass counts
buckets, a second one sums the buckets' gains over each text. Documents are
drawn by Gumbel top-k: their score plus seeded noise, the highest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import number_rows, read, stored
from tidemark.llm.words import CHUNK, LETTERS, Vocabulary, chunks

GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Positions of one suffix array, and words after which a vocabulary is begun anew.
SEGMENT, VOCABULARY = 1 << 19, 1 << 19


def suffix_runs(ids: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For m = 1..n: (suffix array, run of each of its places, first place of each run); 0 in ids is a gap.

    Suffixes are sorted by their first n ids through prefix doubling. Neighbours
    are in one run of m if they share m ids without a gap.
    """
    size = len(ids)
    rank, depth = ids, 1
    while True:
        step = min(depth, n - depth)
        if step:
            rank = rank * (int(rank.max(initial=0)) + 1) + np.concatenate([rank[step:], np.zeros(step, np.int64)])
        depth += step
        if depth >= n:
            break
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    suffixes = np.argsort(rank, kind="stable")
    ends = np.concatenate([ids, np.zeros(n, np.int64)])
    same = np.ones(max(0, size - 1), bool)
    for m in range(n):
        here = ends[suffixes + m]
        same = same & (here[1:] == here[:-1]) & (here[1:] > 0)
        first = np.flatnonzero(np.concatenate([[True], ~same])) if size else np.empty(0, np.int64)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, size)))
        yield suffixes, run, first


def gram_hashes(ids: np.ndarray, words: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For m = 1..n: (CRC-32 of the m-gram at each place, whether there is one: no gap within)."""
    ends = np.concatenate([ids, np.zeros(n, np.int64)])
    crc, there = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    for m, (suffixes, run, first) in enumerate(suffix_runs(ids, n)):
        there = there & (ends[m : m + len(ids)] > 0)
        at = suffixes[first]
        last = [words[k] if not m else b" " + words[k] for k in ends[at + m].tolist()]
        hashed = np.fromiter(map(zlib.crc32, last, crc[at].tolist()), np.int64, len(at))
        crc = np.empty(len(ids), np.int64)
        crc[suffixes] = hashed[run]
        yield crc, there


def segments(texts: Iterator[bytes], n: int, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, owners, words) of about ``segment`` places; owner is the text's number where an n-gram may begin, else -1.

    A text longer than a chunk lies in several pieces; each goes on with the
    n - 1 words that follow it, which begin no n-gram there.
    """
    vocabulary, ids, owners, held = Vocabulary(), [], [], 0
    for number, raw in enumerate(texts):
        before: np.ndarray | None = None
        parts = chunks(raw, LETTERS, chunk)
        while True:
            words = next(parts, None)
            now = None if words is None else vocabulary.ids(words)
            if before is not None:
                if now is not None and len(now) < n - 1:
                    before = np.concatenate([before, now])
                    continue
                ahead = np.empty(0, np.int64) if now is None else now[: n - 1]
                ids += [before, ahead, np.zeros(1, np.int64)]
                owners += [np.full(len(before), number), np.full(len(ahead) + 1, -1)]
                held += len(before) + len(ahead) + 1
            before = now
            if held >= segment or len(vocabulary.words) > VOCABULARY and before is None:
                yield np.concatenate(ids), np.concatenate(owners), vocabulary.words
                ids, owners, held = [], [], 0
                if before is None and len(vocabulary.words) > VOCABULARY:
                    vocabulary = Vocabulary()
            if now is None:
                break
    if ids:
        yield np.concatenate(ids), np.concatenate(owners), vocabulary.words


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary()))


def bucket_counts(texts: DataFrame, n: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of 1 to n words the column ``text`` has in each bucket: ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids, owners, words in segments(_bytes(batch), n):
                for crc, there in gram_hashes(ids, words, n):
                    total += np.bincount(crc[there & (owners >= 0)] % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "c"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r["bucket"]] = r["c"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor(1000 ln) of its smoothed share in the target over that in the source."""
    k = len(source)
    return np.floor(1000 * np.log((target + 1.0) * (source.sum() + k) / ((source + 1.0) * (target.sum() + k)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = GRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, tie) of every row of docs (doc_id, text): weight is the floored mean gain."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    names = ["doc_id", "n_words", "n_features", "weight", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            sums, counts, word_counts = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for ids, owners, words in segments(_bytes(batch), n):
                for m, (crc, there) in enumerate(gram_hashes(ids, words, n)):
                    at = there & (owners >= 0)
                    here = np.bincount(owners[at], minlength=rows)
                    # Whole numbers below 2^53: exact as doubles.
                    sums += np.bincount(owners[at], gain[crc[at] % len(gain)], rows)
                    counts += here
                    word_counts += here if not m else 0
            weight = sums.astype(np.int64) // np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (word_counts, counts, weight)), batch.column("tie")], names)

    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def resample(docs: DataFrame, target: DataFrame, n: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), drawn towards the texts of target.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are
    drawn, those with the highest scores; rank is null for the others. Null and
    empty texts have no features and weight 0. A null doc_id gets the noise of
    the word ``null`` and comes last among equal scores; repeated rows have a
    rank each. Empty tables are fine on either side; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    # Stored: numbering samples its rows, which would weigh all texts again.
    scored = stored(weighed(docs, gain, n).withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words), "scored")
    drawn = scored.where("fit").count() * percent // 100
    placed = number_rows(scored, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "tie"])
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("row_number") < drawn, F.col("row_number") + 1).alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(g), 2), lambda i: CAST('0x' || substr(hex(encode(g)), i, 2) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b),
v AS (SELECT g, {_CRC} % 10000 AS bucket FROM (SELECT g FROM df UNION SELECT g FROM bf)),
s AS (SELECT bucket, count(*) AS s FROM df JOIN v USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN v USING (g) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN v USING (g) JOIN gain USING (bucket) GROUP BY id),
scored AS (SELECT id, doc_id, len(w.w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d w LEFT JOIN (SELECT * FROM w) x USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= (SELECT count(*) * 25 // 100 FROM scored WHERE fit) THEN r END AS rank FROM ranked"""
