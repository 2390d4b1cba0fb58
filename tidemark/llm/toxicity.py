"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns the words of a clause into symbols. Four transducers read the
symbols and are composed into one machine: negation ("not a ..."), reported
speech ("they said ...", quotes), target ("you ...") and threat ("hurt you").
They rewrite insults as plain, aimed or softened, and aimed threats as one;
the machine's outputs are the matched clauses. A document's evidence is the sum
of their weights; with the text's length it is mapped to a probability by a
logistic curve. The lexicon, the weights of the outputs and the curve are
learned from labelled texts.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, stored, unused, widened
from tidemark.llm.samples import labelled

REJECT, SAMPLE = 0.7, 6000
#: Least likelihood ratio, least odds between the classes taken as equally large, and least share of different surroundings, of a learned insult.
LIKELY, ODDS, VARIED = 25.0, 6.0, 0.5
#: Least toxic texts that have an insult, and least different words that make a stem.
TEXTS, FORMS = 4, 3
#: Words of the grammar in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy shoot stab burn beat töten umbringen vernichten tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your you're u he she they him her them du dich dein ihr euch tu toi vous ton él ella ellos tú usted te".split())
NEGATIONS = frozenset("not never isn't aren't wasn't nicht kein keine nie jamais nunca jamás".split())
REPORTS = frozenset("said says claimed claims wrote called quoted sagte behauptet schrieb dit disait affirme dijo decía afirma".split())
STEMS = range(4, 8)
_WORD, _CLAUSE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]"), re.compile(r"[.;:!?\n]+")
_QUOTES = frozenset("\"“”«»")


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (next state, output symbol); any other symbol passes through to ``rest[state]``."""

    arcs: dict[tuple, tuple]
    rest: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state: object, symbol: str) -> tuple:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """The machine whose second part reads what the first writes, over all states reached by ``symbols``."""
    arcs, open_, seen = {}, [(first.start, second.start)], {(first.start, second.start)}
    while open_:
        state = open_.pop()
        for symbol in symbols:
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out)
            if (a, b) not in seen:
                seen.add((a, b))
                open_.append((a, b))
    return Transducer(arcs, {}, (first.start, second.start))


def _within(trigger: str, rewrites: dict[str, str], reach: int, opens: str | None = None) -> Transducer:
    """After ``trigger``, for ``reach`` symbols (for good if 0), rewrites symbols; the trigger itself is written as ``opens``."""
    states = range(1, (reach or 1) + 1)
    arcs = {(s, trigger): (reach or 1, opens or trigger) for s in (0, *states)}
    after = {s: s - 1 if reach else 1 for s in states}
    arcs |= {(s, symbol): (after[s], to) for s in states for symbol, to in rewrites.items()}
    return Transducer(arcs, {0: 0, **after})


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
NEGATED = _within("negation", {"insult": "softened", "threat": "other"}, 2)
REPORTED = _within("report", {"insult": "softened", "threat": "other"}, 0)
AIMED = _within("target", {"insult": "aimed"}, 3)
THREATENED = _within("threat", {"target": "menace"}, 3, opens="other")
GRAMMAR = functools.reduce(lambda a, b: compose(a, b, (*SYMBOLS, "softened", "aimed", "menace")), (NEGATED, REPORTED, AIMED, THREATENED))
#: Outputs that count. Insults weigh what the lexicon says, times the output's weight, a menace its weight.
OUTPUTS = ("insult", "aimed", "softened", "menace")
_OUTPUT = {name: k for k, name in enumerate(OUTPUTS)}
#: Weights that the labels move: an aimed insult counts a third more, a negated or reported one a half.
PRIOR = (1.0, 1.35, 0.5, 3.0)


@dataclass
class Lexicon:
    """Weights of insults by word and by stem (the first 4 to 7 letters), of the machine's outputs, and the curve's three numbers."""

    words: dict[str, float]
    stems: dict[str, float]
    outputs: tuple[float, ...] = PRIOR
    #: Offset, slope of log evidence, slope of log length.
    curve: tuple[float, float, float] = (-1.0, 2.0, 0.0)

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Of an insult; 0 for any other word."""
        if (w := self._known.get(word)) is None:
            w = self.words.get(word)
            if w is None:
                w = max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)
            if len(self._known) > 500_000:
                self._known.clear()
            self._known[word] = w
        return w

    def matches(self, text: str | None) -> tuple[list[float], int]:
        """(the insults' weights, or the number, of each output; number of words) of a whole text."""
        low, sums = (text or "").lower(), [0.0] * len(OUTPUTS)
        every, weight = _WORD.findall(low), self.weight
        hits = [w for w in set(every) if weight(w) or w in THREATS]
        if hits:
            for clause in _CLAUSE.split(low):
                if any(h in clause for h in hits):
                    self._clause(_WORD.findall(clause), sums)
        return sums, len(every)

    def _clause(self, words: list[str], sums: list[float]) -> None:
        state = GRAMMAR.start
        for word in words:
            held = self.weight(word)
            symbol = "insult" if held else "threat" if word in THREATS else "target" if word in TARGETS else "negation" if word in NEGATIONS else "report" if word in REPORTS or word in _QUOTES else "other"
            state, out = GRAMMAR.step(state, symbol)
            if (k := _OUTPUT.get(out)) is not None:
                sums[k] += held if held else 1.0

    def evidence(self, text: str | None) -> float:
        """Sum of the weights of the matched clauses of a whole text."""
        return float(np.dot(self.matches(text)[0], self.outputs))

    def score(self, text: str | None) -> float:
        sums, n = self.matches(text)
        offset, slope, length = self.curve
        y = offset + slope * np.log1p(np.dot(sums, self.outputs)) + length * np.log1p(n)
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, rest): in how many texts of either class a word, or a stem written with *, is."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "toxic": pa.array([counts[1][k] for k in keys], pa.int64()), "rest": pa.array([counts[0][k] for k in keys], pa.int64())})
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            counts[label].update(words)
            counts[label].update({f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k})
            counts[label][""] += 1
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield rows()
    yield rows()


def _neighbours(keys: set[str]):  # noqa: ANN202
    """(key, around, form) of toxic texts: hashes of the two words around a key and of the word that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, int, int]] = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = ["", *_WORD.findall(text.lower()), ""] if label else []
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    mine = [k for k in (word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)) if k in keys]
                    if mine:
                        around, form = zlib.crc32(f"{before} {after}".encode()), zlib.crc32(word.encode())
                        seen.update((k, around, form) for k in mine)
            rows = sorted(seen)
            yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _, _ in rows], pa.string()), "around": pa.array([x for _, x, _ in rows], pa.int64()), "form": pa.array([x for _, _, x in rows], pa.int64())})

    return run


def fit_curve(sums: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[tuple[float, ...], tuple[float, float, float]]:
    """(weights of the outputs, curve) by regularised logistic regression over texts' matches; the classes count as equally large.

    Plain insults weigh 1; the other outputs' log weights are drawn to those of
    PRIOR, so an output that no text has keeps its own.
    """
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    beta, log_weights, prior = np.array([-1.0, 2.0, 0.0]), np.log(PRIOR[1:]), np.log(PRIOR[1:])
    pull = np.array([1e-3, 1e-3, 1e-3, 1e-2, 1e-2, 1e-2])
    for _ in range(80):
        parts = sums[:, 1:] * np.exp(log_weights)
        evidence = sums[:, 0] + parts.sum(axis=1)
        x = np.column_stack([np.ones(len(label)), np.log1p(evidence), np.log1p(words)])
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slopes = np.column_stack([x, beta[1] * parts / (1 + evidence)[:, None]])
        off = np.concatenate([beta, log_weights - prior])
        step = np.linalg.solve((slopes * (share * p * (1 - p))[:, None]).T @ slopes + np.diag(pull), slopes.T @ (share * (p - label)) + pull * off)
        step = np.clip(step, -1, 1)
        beta, log_weights = beta - step[:3], log_weights - step[3:]
    return (1.0, *np.exp(log_weights).tolist()), (float(beta[0]), max(0.05, float(beta[1])), float(beta[2]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon learned from about ``sample`` labelled rows a class of docs (doc_id, text).

    A word or stem is an insult if toxic texts hold it so much more often that
    chance is ruled out (likelihood ratio of LIKELY or more, and odds of ODDS or
    more between the classes taken as equally large), and if it stands between
    different words: words of one toxic text with many copies don't. Its weight
    is its log odds. Without labelled rows of both classes nothing is an insult.
    Null texts count as empty, repeated rows as often as they come, null labels
    not at all; only doc_id and text are read, so other columns don't matter.
    """
    rows = stored(labelled(docs, labels, "toxic", 3, 1, sample), "labelled")
    totals = rows.select("text", "label").mapInArrow(_counted, "key string, toxic long, rest long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("rest").alias("rest"))
    totals = stored(totals.where((F.col("toxic") >= TEXTS) | (F.col("key") == "")), "keys")
    # Two counts, and later the insults of the bounded sample, reach the driver.
    n1, n0 = totals.where("key = ''").agg(F.sum("toxic"), F.sum("rest")).first()
    if not n1 or not n0:
        return Lexicon({}, {})
    toxic, rest = F.col("toxic"), F.col("rest")
    odds = F.log((toxic + 0.5) / (n1 + 1)) - F.log((rest + 0.5) / (n0 + 1))
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    p, q, every = toxic / n1, rest / n0, (toxic + rest) / (n1 + n0)
    ratio = 2 * (toxic * (log(p) - log(every)) + rest * (log(q) - log(every)) + (n1 - toxic) * (log(1 - p) - log(1 - every)) + (n0 - rest) * (log(1 - q) - log(1 - every)))
    found = totals.where((F.col("key") != "") & (odds >= float(np.log(ODDS))) & (ratio >= LIKELY)).select("key", "toxic", F.least(odds, F.lit(6.0)).alias("odds")).collect()
    likely = {r["key"]: (r["toxic"], r["odds"]) for r in found}
    # Two numbers for each of these keys reach the driver.
    seen = rows.select("text", "label").mapInArrow(_neighbours(set(likely)), "key string, around long, form long").distinct().groupBy("key").agg(F.countDistinct("around"), F.countDistinct("form"))
    varied = {key: forms for key, around, forms in seen.collect() if around >= max(TEXTS, VARIED * likely[key][0])}
    longer: dict[str, int] = {}
    for key in varied:
        if key.endswith("*"):
            longer[key[:-2]] = max(longer.get(key[:-2], 0), likely[key][0])
    words, stems = {}, {}
    for key, forms in varied.items():
        stem = key.rstrip("*")
        if stem == key:
            words[key] = likely[key][1]
        elif forms >= FORMS and longer.get(stem, 0) < 0.95 * likely[key][0]:  # else a longer stem says as much
            stems[stem] = likely[key][1]
    lexicon = Lexicon(words, stems)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(words, stems)
        for batch in batches:
            told = [own.matches(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in told], pa.list_(pa.float64())), pa.array([n for _, n in told], pa.int64()), batch.column("label")], ["sums", "words", "label"])

    # A few numbers for each row of the bounded sample reach the driver.
    told = rows.select("text", "label").mapInArrow(matched, "sums array<double>, words long, label int").toPandas()
    lexicon.outputs, lexicon.curve = fit_curve(np.array(told["sums"].to_list()).reshape(-1, len(OUTPUTS)), told["words"].to_numpy(float), told["label"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, reject: float = REJECT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted (1 if score >= reject) under the given names; they replace columns so named.

    Null texts count as empty; texts without a match have the curve's score for
    no evidence. Repeated rows score alike.
    """
    held = docs.drop(*names)
    columns = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.words, lexicon.stems, lexicon.outputs, lexicon.curve)
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= reject) for s in found], pa.int32())], [*columns, *names])

    return held.mapInArrow(run, widened(held, f"{names[0]} double, {names[1]} int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that aren't predicted toxic, all columns kept; learned from the labelled rows among docs.

    Null and empty texts stay unless the empty text itself is predicted toxic;
    repeated rows share their fate; an empty table, or one without labelled rows
    of both classes, stays as it is.
    """
    toxicity, toxic = unused(docs, "_toxicity", "_toxic")
    return score(docs, learn(docs, labels), names=(toxicity, toxic)).where(F.col(toxic) == 0).drop(toxicity, toxic)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    told = score(docs, learn(docs, read(spark, sf_dir, "labels")))
    return told.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score", "predicted")
