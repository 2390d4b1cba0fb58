"""Language ID by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3, word ends
marked) in order, counted over all training texts. A document goes to the
language whose profile its own n-grams' ranks are least out of place with.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, stored, unused, widened

PROFILE, UNKNOWN = 400, "und"
_CHUNK, _HELD = 1 << 19, 1 << 20
_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point its lower case, or a space if it isn't a letter."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes ascending, counts) of all n-grams of a text; none if it has no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint64)
    gap = codes == _SPACE
    codes = codes[~(gap & np.concatenate([[False], gap[:-1]]))]
    kept: tuple[np.ndarray, np.ndarray] = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(codes) < 2:
        return kept
    for start in range(0, len(codes), _CHUNK):
        c = codes[start : start + _CHUNK + 2]
        n = min(_CHUNK, len(codes) - start)
        one, two, space = c[:n], c[:-1][:n] << np.uint64(21) | c[1:][:n], c == _SPACE
        three = two[: max(0, len(c) - 2)] << np.uint64(21) | c[2:][:n]
        found = np.concatenate([one[~space[:n]], two, three[~space[1:-1][: len(three)]]])
        kept = _merged([kept, np.unique(found, return_counts=True)])
    return kept


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [p for p in parts if len(p[0])]
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = defaultdict(list)
    waiting: dict[str, list[str]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def close(lang: str) -> None:
        held[lang] = [_merged([*held[lang], ngrams("\n".join(waiting.pop(lang, [])))])]
        sizes.pop(lang, None)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = _merged(parts)
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(counts)], ["lang", "code", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting[lang].append(text)
            sizes[lang] += len(text)
            if sizes[lang] > _CHUNK:
                close(lang)
        if sum(len(p[0]) for parts in held.values() for p in parts) > _HELD:
            yield from rows()
    for lang in list(waiting):
        close(lang)
    yield from rows()


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Ranked n-grams of every language of docs (text, lang), counted over all rows whose text and lang aren't null.

    N-grams of equal count go by code point. A language whose texts have no
    letter has no profile; an empty table gives none. Repeated rows count again.
    """
    counts = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_count, "lang string, code long, n long")
    total = stored(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    # The floor that the size-th count of a language sets leaves few rows for each window.
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    # ``size`` rows a language reach the driver.
    out: dict[str, list] = defaultdict(list)
    for lang, code, _, rank in best.select("lang", "code", "n", "rank").collect():
        out[lang].append((rank, code))
    return {lang: np.array([c for _, c in sorted(found)], np.uint64) for lang, found in sorted(out.items())}


class Ranker:
    """Out-of-place distances to the profiles of all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.langs, self.size = list(profiles), size
        self.known = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(profiles), len(self.known) + 1), -1, np.int32)
        for k, codes in enumerate(profiles.values()):
            self.ranks[k, np.searchsorted(self.known, codes)] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text) if text else ((), ())
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.size)
        at = np.searchsorted(self.known, top)
        at[self.known[np.minimum(at, len(self.known) - 1)] != top] = len(self.known)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(top)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (1: the profile itself, 0: nothing shared) under the given names; they replace columns so named.

    Null texts and texts without letters are ``und`` with score 0; so is
    everything if no language was learned. Distances that tie go to the
    language first by code point. Rows and other columns stay as they are.
    """
    held = docs.drop(*names)
    columns = held.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, size)
        for batch in batches:
            found = [ranker.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*columns, *names])

    return held.mapInArrow(predict, widened(held, f"{names[0]} string, {names[1]} double"))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False)))


def keep_known(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows of docs whose text is in a language learned from docs themselves; texts unlike any (score under ``least``) go.

    So do null texts and those without letters. All columns stay; repeated rows
    share their fate; where no language can be learned nothing is known, and all
    rows go.
    """
    lang, fit = unused(docs, "_lang", "_fit")
    told = identify(docs, learn_profiles(learning_rows(docs)), names=(lang, fit))
    return told.where((F.col(lang) != UNKNOWN) & (F.col(fit) >= least)).drop(lang, fit)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn_profiles(learning_rows(docs.select("doc_id", "text", "lang")))
    told = identify(docs.select("doc_id", "text"), profiles)
    return told.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score")
