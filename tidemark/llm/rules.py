"""Quality rules with risk-controlled cutoffs.

A rule gives a document a level from 0 to 63, the higher the worse; a cutoff
rejects all levels from it on. In each stratum (language) labelled documents
are held out to test, for each rule, cutoffs from the loosest to the tightest:
one is certified while the exact binomial probability of so few rejected good
documents, were the rule's share of the risk exceeded, stays at or under its
share of the error, and testing stops at the first that isn't. Tests in such a
fixed order need no correction among themselves; rules and strata share the
error by Bonferroni and the rules of a stratum share its risk, so with probability 1 - ERROR no stratum
loses more than RISK of its good documents. Of the certified cutoffs the one is
taken that rejects the largest share of bad documents less WORTH times that of
good ones, the loosest of equals; none if that is never above 0. Where labels are too few to certify anything, nothing is rejected
beyond the fixed base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, stored
from tidemark.llm.words import SPACED, Vocabulary, chunks

RISK, ERROR, WORTH, LEVELS, WINDOW = 0.05, 0.05, 10, 64, 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words of one sorted array; a text with more has an array of its own.
SEGMENT = 1 << 19
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SPACES_AND_TAILS = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"


def repeated_words(ids: np.ndarray, owners: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word stands in a window of its owner's words that this owner has twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    starts = np.flatnonzero(owners[:n] == owners[window - 1 :])
    # A 64-bit mix sorts equal windows together; neighbours are then compared word by word.
    mix = owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mix[starts]
    for k in range(window):
        key = (key ^ (key >> np.uint64(29)) ^ ids[starts + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    order = starts[np.argsort(key, kind="stable")]
    a, b = order[:-1], order[1:]
    same = owners[a] == owners[b]
    for k in range(window):
        same &= ids[a + k] == ids[b + k]
    edges = np.zeros(len(ids) + 1, np.int64)
    twice = np.unique(np.concatenate([a[same], b[same]]))
    edges[twice] += 1
    edges[twice + window] -= 1
    return np.cumsum(edges)[:-1] > 0


def measure(texts: list[bytes]) -> np.ndarray:
    """METRICS of UTF-8 texts, a row each."""
    out = np.zeros((len(texts), len(METRICS)), np.int64)
    vocabulary, ids, owners, held = Vocabulary(), [], [], 0

    def flush() -> None:
        nonlocal vocabulary, held
        if ids:
            owner = np.concatenate(owners)
            out[:, 4] += np.bincount(owner[repeated_words(np.concatenate(ids), owner)], minlength=len(texts))
            ids.clear()
            owners.clear()
        vocabulary, held = Vocabulary(), 0

    for k, raw in enumerate(texts):
        n = 0
        for words in chunks(raw, SPACED):
            ids.append(vocabulary.ids(words))
            n += len(words)
        if n:
            owners.append(np.full(n, k))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[k] = n, len(raw.translate(None, _SPACES_AND_TAILS)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines)
        held += n
        if held >= SEGMENT:
            flush()
    flush()
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, key, METRICS) of every row of docs (doc_id, lang, text); key is the stratum, ``-`` for a null lang."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure([t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c) for c in found.T.copy())], ["doc_id", "key", *METRICS])

    return slim.mapInArrow(run, "doc_id long, key string, " + ", ".join(f"{c} long" for c in METRICS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def levels() -> dict[str, Column]:
    """Each rule's level of a measured row, 0 to LEVELS - 1."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def level(x: Column) -> Column:
        return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(LEVELS - 1)).cast("int")

    return {
        "symbols": level(100 * F.col("n_symbols") / words),
        "duplicate_lines": level(LEVELS * F.col("n_dup_lines") / lines),
        "repeated_words": level(LEVELS * 5 * F.col("n_repeat_words") / words),
        "long_words": level(4 * F.col("word_chars") / words),
        "short_words": level(LEVELS - 8 * F.col("word_chars") / words),
    }


def certified(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> int | None:
    """The chosen cutoff of a rule from labelled documents by level, or None."""
    n, best, chosen = int(good.sum()), 0.0, None
    if not n or not bad.sum():
        return None
    rejected = np.cumsum(good[::-1])[::-1]
    gone = np.cumsum(bad[::-1])[::-1]
    # log P(X = i) for X ~ Binomial(n, risk), up to the mean; beyond it nothing is certified.
    most = int(n * risk)
    i = np.arange(most)
    logs = n * np.log1p(-risk) + np.concatenate([[0.0], np.cumsum(np.log(n - i) - np.log(i + 1) + np.log(risk / (1 - risk)))])
    below = np.logaddexp.accumulate(logs)
    for cut in range(len(good) - 1, 0, -1):
        k = int(rejected[cut])
        if k > most or below[k] > np.log(error):
            break
        gain = gone[cut] / bad.sum() - WORTH * k / n
        if gain > best:
            best, chosen = gain, cut
    return chosen


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(key, a cutoff column for each rule) of measured rows' strata, from all labelled rows that pass the base rules.

    Labels other than 0 and 1 and those without doc_id don't count; of several of
    one doc_id the least does. A null cutoff rejects nothing.
    """
    rules = list(levels())
    slim = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    held = rows.where(~base_failed()).join(slim, "doc_id").select("key", "good", F.posexplode(F.array(*levels().values())).alias("rule", "level"))
    counts = held.groupBy("key", "good", "rule", "level").agg(F.count("*").alias("c"))
    # One number reaches the driver: how many strata share the error.
    strata = max(1, rows.select("key").distinct().count())

    def decide(of: pd.DataFrame) -> pd.DataFrame:
        # A stratum's counts: at most 2 labels of 5 rules of 64 levels.
        table = np.zeros((len(rules), 2, LEVELS), np.int64)
        table[of["rule"], of["good"], of["level"]] = of["c"]
        found = [certified(t[1], t[0], risk / len(rules), error / len(rules) / strata) for t in table]
        return pd.DataFrame({"key": [of["key"].iloc[0]]} | {f"cut_{r}": pd.array([c], "Int32") for r, c in zip(rules, found, strict=True)})

    return counts.groupBy("key").applyInPandas(decide, "key string, " + ", ".join(f"cut_{r} int" for r in rules))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, METRICS, base_failed, kept, failed_rules) of every row of docs (doc_id, lang, text).

    Null texts count as empty and fail the base rules (no words). A stratum
    without labels, and every one if labels is empty, keeps all that passes the
    base rules. Repeated rows are judged alike; a row without doc_id is judged
    but teaches nothing; an empty table gives no rows; further columns are ignored.
    """
    rows = stored(measured(docs), "measured")
    # Stored, so that its size is known when the join is planned: a row for each stratum.
    cuts = stored(cutoffs(rows, labels, risk, error), "cutoffs")
    failed = F.array_compact(F.array(*(F.when(level >= F.col(f"cut_{rule}"), F.lit(rule)) for rule, level in levels().items())))
    return rows.join(cuts, "key", "left").select("doc_id", *METRICS, base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *METRICS[:5], "base_failed", "kept", "failed_rules")
