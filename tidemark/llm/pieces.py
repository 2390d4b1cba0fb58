"""SentencePiece encoding, decoding and sampling of segmentations.

A text becomes one string with U+2581 for spaces and before the first word; its
words (U+2581 and what follows; those of over 48 code points are cut further where
no vocabulary piece can span the cut, and nowhere else) are lattices of
vocabulary pieces, with UTF-8 bytes for characters that no piece has. A piece's weight is 1 / (its rank in the vocabulary + 10), times a constant
for each character it spans: the probability of a segmentation is the product
of its pieces' weights over the sum of all, and doesn't depend on the constant.

The encoding is the likeliest segmentation. Samples are drawn without
replacement by Gumbel top-k: a best-first (A-star) search over the tree of
partial segmentations, perturbed so that each node's bound is the greatest
perturbed log probability below it. The best leaf is an ordinary sample, and
each further one leaves an earlier path at the node with the greatest bound.
Random numbers depend on the row key alone.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, unused, widened

MODEL, SAMPLES, SEED = "/opt/tokenizers/piece_bpe_32k.model", 3, 17
MARK, _SPLIT = "▁", 48
#: Farther than this from a word's end masses are scaled; those of so many characters spelled in four bytes are still in range.
_RESCALE = 16
#: A block: its rows are sampled at once. The blocks of a group have common the lattices of words that _OFTEN of them or more hold.
_BATCH_CHARS, _GROUP_CHARS, _OFTEN = 1 << 20, 1 << 24, 3
_NONE, _BYTES = -1, -2
_END = np.iinfo(np.int32).max  # where an edge to its word's end leads
_LITERAL = "\ud800"  # stands for U+2581 in a text; no text has it


@dataclass(frozen=True)
class Vocabulary:
    """A model's pieces: ``byte_id`` is the id of byte 0, the other 255 follow."""

    texts: tuple[str, ...]
    byte_id: int

    @functools.cached_property
    def spelling(self) -> pa.Array:
        """What each id adds to a text, as bytes."""
        return pa.array([bytes([k - self.byte_id]) if self.byte_id <= k < self.byte_id + 256 else t.replace(MARK, " ").encode() for k, t in enumerate(self.texts)], pa.large_binary())

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.texts), default=1)

    @functools.cached_property
    def weights(self) -> np.ndarray:
        """Of each piece its weight, times a constant for a character: about what one of a usual piece costs."""
        return np.array([np.exp(2.2 * len(t)) / (k + 10) for k, t in enumerate(self.texts)] + [0.0])

    @functools.cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of each code point, next state by state and class, piece at each state)."""
        pieces = {t: k for k, t in enumerate(self.texts) if t}
        alphabet = sorted({c for t in pieces for c in t})
        classes = np.zeros(0x110000, np.int32)
        classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        states: dict[tuple[int, str], int] = {}
        piece = [_NONE]
        for text, k in pieces.items():
            at = 0
            for c in text:
                if (at, c) not in states:
                    states[at, c] = len(piece)
                    piece.append(_NONE)
                at = states[at, c]
            piece[at] = k
        # Most states have few ways on: a hash table of (state, class) with open addressing.
        size = 1 << (4 * len(states)).bit_length()
        keys, to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for (state, c), nxt in states.items():
            key = state << 16 | int(classes[ord(c)])
            slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - size.bit_length() + 1)
            while keys[slot] >= 0:
                slot = (slot + 1) % size
            keys[slot], to[slot] = key, nxt
        return classes, np.stack([keys, to.astype(np.int64)]), np.array(piece, np.int32)

    @functools.cached_property
    def mark_inside(self) -> bool:
        """Whether a piece has U+2581 behind another character, and so may span two words."""
        return any(MARK in t.lstrip(MARK) for t in self.texts)

    @functools.cached_property
    def begun(self) -> np.ndarray:
        """The state after one character, by its class."""
        some = np.arange(int(self.trie[0].max()) + 1)
        return self.follow(np.zeros(len(some), np.int32), some)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        table = self.trie[1]
        size = table.shape[1]
        key = state.astype(np.int64) << 16 | symbol
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
        out = np.zeros(len(key), np.int32)
        left = np.arange(len(key))
        while len(left):
            found = table[0, slot]
            hit = found == key
            out[left[hit]] = table[1, slot[hit]]
            more = ~hit & (found >= 0)
            left, key, slot = left[more], key[more], (slot[more] + 1) % size
        return out


@functools.lru_cache(4)
def _loaded(model: bytes) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = tuple("" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return Vocabulary(texts, sp.piece_to_id("<0x00>"))


def load(path: str = MODEL) -> bytes:
    """The model file, read by the driver and sent to the executors."""
    with open(path, "rb") as f:
        return f.read()


def marked(text: str) -> str:
    """Text as the lattice sees it. U+2581 in a text stays apart from a space: it is spelled in bytes."""
    return MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)


_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _cut(word: str, vocabulary: Vocabulary) -> list[str]:
    """The word in parts: a cut is where no piece found in the word spans it, so the lattice stays the same."""
    classes, _, piece = vocabulary.trie
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, symbols = len(codes), classes[codes]
    spans, at, state = np.zeros(n + 1, np.int64), np.arange(n), np.zeros(n, np.int32)
    for length in range(1, vocabulary.longest + 1):
        state = vocabulary.follow(state, symbols[at + length - 1])
        alive = state > 0
        at, state = at[alive], state[alive]
        if length > 1:
            whole = at[piece[state] >= 0]
            np.add.at(spans, whole + 1, 1)
            np.add.at(spans, whole + length, -1)
        more = at + length < n
        at, state = at[more], state[more]
    cuts = np.flatnonzero(np.cumsum(spans)[1:n] == 0) + 1
    # No more cuts than keep the parts at _SPLIT code points where that can be.
    parts, start = [], 0
    while start < n:
        k = int(np.searchsorted(cuts, start + _SPLIT, "right")) - 1
        if n - start <= _SPLIT:
            end = n
        elif k >= 0 and cuts[k] > start:
            end = int(cuts[k])
        else:
            end = int(cuts[k + 1]) if k + 1 < len(cuts) else n
        parts.append(word[start:end])
        start = end
    return parts


def words_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """The words of a text; their concatenation is marked(text), but the empty text has none."""
    if not text:
        return []
    return [marked(text)] if vocabulary.mark_inside else _WORDS.findall(marked(text))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    heads = np.cumsum(sizes) - sizes
    return np.repeat(starts - heads, sizes) + np.arange(sizes.sum())


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def word_places(texts: pa.Array, vocabulary: Vocabulary) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, joined; their lengths; places of all words of all texts among them; first word of each text and the end)."""
    odd = pc.or_(pc.equal(texts, ""), pc.match_substring(texts, MARK))
    for found in (pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.ends_with(texts, " ")):
        odd = pc.or_(odd, found)
    odd = np.ones(len(texts), bool) if vocabulary.mark_inside else odd.to_numpy(zero_copy_only=False)
    # Where spaces are single and inside, a word is what lies between two.
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    coded = plain.flatten().dictionary_encode()
    counts = np.zeros(len(texts), np.int64)
    counts[~odd] = plain.value_lengths().to_numpy(zero_copy_only=False)
    names = pc.binary_join_element_wise(MARK, coded.dictionary, "")
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    if not odd.any() and lengths.max(initial=0) <= _SPLIT:
        joined = names.buffers()[2].to_pybytes().decode() if len(names) else ""
        return joined, lengths, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _firsts(counts)
    known = {w: k for k, w in enumerate(names.to_pylist())}
    rest = [[known.setdefault(w, len(known)) for w in words_of(texts[k].as_py(), vocabulary)] for k in np.flatnonzero(odd).tolist()]
    counts[odd] = list(map(len, rest))
    first = _firsts(counts)
    places = np.empty(first[-1], np.int64)
    places[_ranges(first[:-1][~odd], counts[~odd])] = coded.indices.to_numpy(zero_copy_only=False)
    if rest:
        places[_ranges(first[:-1][odd], counts[odd])] = np.fromiter((w for r in rest for w in r), np.int64, int(counts[odd].sum()))
    parts: dict[str, int] = {}
    lists = [[parts.setdefault(p, len(parts)) for p in (_cut(w, vocabulary) if len(w) > _SPLIT else (w,))] for w in known]
    own = _firsts(np.fromiter(map(len, lists), np.int64, len(lists)))
    counts = np.diff(own)[places]
    into = np.fromiter((p for x in lists for p in x), np.int64, own[-1])
    return "".join(parts), np.fromiter(map(len, parts), np.int64, len(parts)), into[_ranges(own[places], counts)], _firsts(counts)[first]


class Lattice:
    """The lattices of distinct words, side by side: edges, shares of all ways to the word's end, likeliest ways."""

    def __init__(self, written: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> None:
        """``written``: the words' code points, joined; ``sizes`` their lengths."""
        classes, _, piece = vocabulary.trie
        # Places go by distance from their word's end, then by word, longer ones first: those of equal distance lie side by side.
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        many = np.searchsorted(-sizes[order], -np.arange(longest + 2), "right")  # words of that length or more
        many[0] = 0
        offset = np.concatenate([np.cumsum(many) - many, [0]])
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        self.starts = offset[sizes] + rank
        n = len(written)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        self.codes = np.empty(n, np.uint32)
        self.codes[offset[left] + np.repeat(rank, sizes)] = written
        symbols = classes[self.codes]
        at = np.arange(n)
        left = np.repeat(np.arange(longest + 2), many)
        word = at - offset[left]
        edges, spelled = [], np.ones(n, bool)
        for length in range(1, vocabulary.longest + 1):
            state = vocabulary.follow(state, symbols[offset[left - length + 1] + word]) if length > 1 else vocabulary.begun[symbols]
            found = piece[state]
            has = np.flatnonzero(found >= 0)
            where, room, of = at[has], left[has], word[has]
            if length == 1:
                spelled[where] = False
            edges.append((where, np.where(room > length, offset[room - length] + of, n), found[has]))
            more = np.flatnonzero((state > 0) & (left > length))
            at, state, left, word = at[more], state[more], left[more], word[more]
        # A character without a piece is spelled in UTF-8 bytes.
        lone = np.flatnonzero(spelled)
        of = np.searchsorted(offset[1 : longest + 2], lone, "right")
        width = 1 + (self.codes[lone] > 0x7F) + (self.codes[lone] > 0x7FF) + (self.codes[lone] > 0xFFFF)
        edges.insert(0, (lone, np.where(of > 1, offset[of - 1] + lone - offset[of], n), _BYTES))
        # Side by side by place, the longest first: it is the likeliest more often than not.
        count = np.zeros(n, np.int64)
        for where, *_ in edges:
            count[where] += 1
        self.first = _firsts(count)
        self.to, self.piece = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int32)
        free = self.first[1:].copy()
        for where, to, pieces in edges:
            e = free[where] - 1
            free[where] = e
            self.to[e], self.piece[e] = to, pieces
        weight = vocabulary.weights[self.piece]
        weight[self.first[lone + 1] - 1] = np.exp(2.2) * (1 / (len(vocabulary.texts) + 10.0)) ** width
        del edges
        total, best = np.ones(n + 1), np.ones(n + 1)  # the last: the end of any word
        # Logarithms of what the two are divided by, far from a word's end: no product of many weights leaves the numbers' range.
        low_total, low_best = np.zeros(n + 1), np.zeros(n + 1)
        self.way, self.place = np.zeros(n, np.int64), np.repeat(np.arange(n, dtype=np.int32), count)
        share = np.empty(len(weight))
        # From the words' ends backwards, all words at once.
        for distance in range(1, longest + 1):
            here = slice(offset[distance], offset[distance] + many[distance])
            every = slice(self.first[here.start], self.first[here.stop])
            heads, n_edges, to, w = self.first[here] - every.start, count[here], self.to[every], weight[every]
            if distance > _RESCALE:
                then = slice(offset[distance - 1], offset[distance - 1] + many[distance])
                by_total, by_best = low_total[then] + np.log(total[then]), low_best[then] + np.log(best[then])
                mass = w * np.exp(low_total[to] + np.log(total[to]) - np.repeat(by_total, n_edges))
                peak = w * np.exp(low_best[to] + np.log(best[to]) - np.repeat(by_best, n_edges))
            else:
                mass, peak = w * total[to], w * best[to]
            total[here], best[here] = np.add.reduceat(mass, heads), np.maximum.reduceat(peak, heads)
            share[every] = mass / np.repeat(total[here], n_edges)
            top = np.flatnonzero(peak == np.repeat(best[here], n_edges)) + every.start
            self.way[self.place[top]] = top  # of equal ways the shortest piece
            if distance > _RESCALE:
                low_total[here], low_best[here] = by_total + np.log(total[here]), by_best + np.log(best[here])
                total[here] = best[here] = 1.0
        self.to[self.to == n] = _END
        before = np.cumsum(share)
        self.share, self.upto = share, before - np.repeat(before[self.first[:-1]] - share[self.first[:-1]], count)
        # What the lesser edges of a place have together, so that little isn't lost beside 1.
        self.lesser = np.add.reduceat(np.where(share > 0.5, 0.0, share), self.first[:-1]) if n else np.zeros(0)

    def log_share(self, edges: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.share[edges])

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Logarithms of what the other edges of the edges' places have: summed where it is the lesser part."""
        share = self.share[edges]
        with np.errstate(divide="ignore"):
            return np.log(np.where(share > 0.5, self.lesser[self.place[edges]], 1 - share))

    def likeliest(self) -> tuple[np.ndarray, np.ndarray]:
        """(first edge of each word and the end, edges) of the best ways of all words."""
        sizes, edges = self._walk(self.starts, lambda at, _who, _r: self.way[at])
        return _firsts(sizes), edges

    def sampled(self, at: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """(lengths, edges) of ways drawn by probability from the given places; draw(who, round) gives uniform numbers."""
        return self._walk(at, lambda here, who, r: self._drawn(here, draw(who, r)))

    def _drawn(self, here: np.ndarray, u: np.ndarray) -> np.ndarray:
        e, last = self.first[here], self.first[here + 1] - 1
        todo = np.flatnonzero((self.upto[e] <= u) & (e < last))
        while len(todo):
            e[todo] += 1
            now = e[todo]
            todo = todo[(self.upto[now] <= u[todo]) & (now < last[todo])]
        return e

    def _walk(self, at: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        found, who, sizes = [], np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(who):
            e = choose(at, who, len(found))
            found.append((who, e))
            sizes[who] += 1
            to = self.to[e]
            more = to < _END
            at, who = to[more], who[more]
        first, out = np.cumsum(sizes) - sizes, np.empty(sizes.sum(), np.int64)
        for r, (who, e) in enumerate(found):
            out[first[who] + r] = e
        return sizes, out


class Shelf(Lattice):
    """Lattices joined into one: some stay, others behind them make room for the next. Its arrays may be longer than what is in use."""

    _OF_PLACES, _OF_EDGES = ("codes", "first", "way", "lesser"), ("to", "piece", "place", "share", "upto")

    def __init__(self, lattices: Iterable[Lattice]) -> None:
        """Of the lattices that stay."""
        self.starts, self.kept = np.zeros(0, np.int64), (0, 0, 0)
        for lattice in lattices:
            self.put(lattice)
            self.kept = self.size

    def put(self, more: Lattice) -> None:
        """Place a lattice behind those that stay."""
        words, places, edges = self.kept
        self.size = words + len(more.starts), places + len(more.codes), edges + len(more.to)
        self.starts = np.concatenate([self.starts[:words], more.starts + places])
        shifts = {"first": edges, "way": edges, "place": places}
        for name in (*self._OF_PLACES, *self._OF_EDGES):
            new, at = getattr(more, name), places if name in self._OF_PLACES else edges
            held = getattr(self, name, new[:0])
            if len(held) < at + len(new):
                room = np.empty((at + len(new)) * 9 // 8, new.dtype)
                room[:at] = held[:at]
                setattr(self, name, held := room)
            here = held[at : at + len(new)]
            if name == "to":
                np.add(new, places, out=here, where=new < _END)
                here[new == _END] = _END
            else:
                np.add(new, new.dtype.type(shifts[name]), out=here) if name in shifts else np.copyto(here, new)


def _mixed(x: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """A hash of a hash and a further part (SplitMix64; its three numbers are fixed values)."""
    with np.errstate(over="ignore"):
        x = np.asarray(part).astype(np.uint64, casting="unsafe") + x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashed(*parts: np.ndarray | int) -> np.ndarray:
    return functools.reduce(_mixed, parts, np.uint64(0))


def _uniform(hashed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of hashes."""
    return ((hashed >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def _below(where: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at log masses ``where``, each held below its bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(where), -np.inf, where - np.log(np.exp(np.minimum(where - bound, 700)) - np.log(u)))


@dataclass
class _Paths:
    """One path a text, as steps side by side: word, edge, log probability of the steps before, bound of the other ways."""

    first: np.ndarray
    word: np.ndarray
    edge: np.ndarray
    before: np.ndarray
    bound: np.ndarray
    logp: np.ndarray
    #: Of steps that later paths left at: the edges taken there.
    gone: dict[int, set[int]] = field(default_factory=dict)


def _top(path: _Paths, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(greatest bound, its step) of each text's path; -inf without one."""
    top, where, sizes = np.full(n, -np.inf), np.zeros(n, np.int64), np.diff(path.first)
    if some := len(path.bound):
        full = np.flatnonzero(sizes > 0)
        top[full] = np.maximum.reduceat(path.bound, path.first[full])
        hits = np.flatnonzero(path.bound == np.repeat(top, sizes))
        where[np.repeat(np.arange(n), sizes)[hits][::-1]] = hits[::-1]
    assert some or not sizes.any()
    return top, where


def sample_segmentations(lattice: Lattice, words: np.ndarray, texts: np.ndarray, keys: np.ndarray, samples: int) -> list[tuple[_Paths, np.ndarray, np.ndarray]]:
    """``samples`` rounds of (paths, perturbed log probability, log inclusion threshold) for all texts at once.

    words: the lattice's word at each place; texts: the first place of each text
    and the end; keys: a number for each text. A text with fewer segmentations
    than samples has -inf in the later rounds.
    """
    n, place_text = len(texts) - 1, np.repeat(np.arange(len(texts) - 1), np.diff(texts))
    place_in_text = np.arange(len(words)) - texts[place_text]
    starts = lattice.starts[words]
    rounds: list[_Paths] = []
    values: list[np.ndarray] = []
    value = -np.log(-np.log(_uniform(_hashed(keys, 1001, 0))))
    alive = np.ones(n, bool)
    for s in range(samples + 1):
        kept_sizes, kept_parts = np.zeros(n, np.int64), []
        if s == 0:
            owners, at, alt = np.arange(len(words)), starts, None
        else:
            # The greatest bound of each text over all earlier paths, and its step.
            best, source, step = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for r, path in enumerate(rounds):
                top, where = _top(path, n)
                better = top > best
                best[better], source[better], step[better] = top[better], r, where[better]
            if s == samples:
                break
            alive, value = best > -np.inf, best
            alt_edge, alt_word = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for r, path in enumerate(rounds):
                mine = np.flatnonzero(alive & (source == r))
                if not len(mine):
                    continue
                at_step = step[mine]
                kept_sizes[mine] = at_step - path.first[mine]
                kept_parts.append((mine, r))
                # Choose among the ways not yet taken there, by their share of what is left.
                place, others = lattice.place[path.edge[at_step]], np.full(len(mine), -np.inf)
                u = _uniform(_hashed(keys[mine], s, 1003))
                for k, (m, st, p) in enumerate(zip(mine.tolist(), at_step.tolist(), place.tolist(), strict=True)):
                    gone = path.gone.setdefault(st, {int(path.edge[st])})
                    edges = [e for e in range(int(lattice.first[p]), int(lattice.first[p + 1])) if e not in gone]
                    shares = lattice.share[edges]
                    upto = np.cumsum(shares)
                    taken = min(int(np.searchsorted(upto, u[k] * upto[-1], "right")), len(edges) - 1)
                    alt_edge[m] = edges[taken]
                    gone.add(edges[taken])
                    if len(edges) > 1 and (rest := float(np.delete(shares, taken).sum())) > 0:
                        others[k] = path.before[st] + np.log(rest)
                alt_word[mine] = path.word[at_step]
                path.bound[at_step] = _below(others, value[mine], _uniform(_hashed(keys[mine], s, 1004)))
            # Fresh draws: the rest of the word left at, and all later words.
            live = np.flatnonzero(alive)
            to = lattice.to[alt_edge[live]]
            inner = to < _END
            later = np.flatnonzero(alive[place_text] & (np.arange(len(words)) > alt_word[place_text]))
            owners = np.concatenate([alt_word[live][inner], later])
            at = np.concatenate([to[inner], starts[later]])
            order = np.argsort(owners, kind="stable")
            owners, at, alt = owners[order], at[order], (alt_word, alt_edge)
        own = _mixed(_hashed(keys, s)[place_text[owners]], place_in_text[owners])
        lengths, fresh_edge = lattice.sampled(at, lambda who, r, own=own: _uniform(_mixed(own[who], r)))
        fresh_word = np.repeat(owners, lengths)
        fresh_sizes = np.zeros(n, np.int64)
        np.add.at(fresh_sizes, place_text[owners], lengths)
        sizes = kept_sizes + (alive if alt else 0) + fresh_sizes
        first = _firsts(sizes)
        word, edge = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        if alt:
            for mine, r in kept_parts:
                to, src = _ranges(first[mine], kept_sizes[mine]), _ranges(rounds[r].first[mine], kept_sizes[mine])
                word[to], edge[to] = rounds[r].word[src], rounds[r].edge[src]
            live = np.flatnonzero(alive)
            word[first[live] + kept_sizes[live]], edge[first[live] + kept_sizes[live]] = alt[0][live], alt[1][live]
        to = _ranges(first[1:] - fresh_sizes, fresh_sizes)
        word[to], edge[to] = fresh_word, fresh_edge
        upto = np.concatenate([[0.0], np.cumsum(lattice.log_share(edge))])
        before = upto[:-1] - np.repeat(upto[first[:-1]], sizes)
        # Nodes on the shared prefix, the one it left included, belong to the earlier path.
        bound = np.full(len(edge), -np.inf)
        owner = np.repeat(np.arange(n), fresh_sizes)
        bound[to] = _below(before[to] + lattice.log_rest(fresh_edge), value[owner], _uniform(_mixed(_hashed(keys, s, 1002)[owner], to - first[owner])))
        rounds.append(_Paths(first, word, edge, before, bound, upto[first[1:]] - upto[first[:-1]]))
        values.append(np.where(alive, value, -np.inf))
    return [(p, v, best) for p, v in zip(rounds, values, strict=True)] if samples else []


def _spelled(lattice: Lattice, edges: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each run and the end) of runs of edges, with bytes for characters without a piece."""
    ids = lattice.piece[edges]
    if not (odd := np.flatnonzero(ids == _BYTES)).size:
        return ids, first
    place = lattice.place[edges[odd]]
    raw = [(MARK if chr(c) == _LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in lattice.codes[place].tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[odd] = [len(b) for b in raw]
    starts = _firsts(sizes)
    out = np.empty(starts[-1], ids.dtype)
    out[starts[:-1]] = ids
    out[_ranges(starts[odd], sizes[odd])] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + vocabulary.byte_id
    return out, starts[first]


@dataclass
class Segmented:
    """Encodings of texts, side by side (ids, first of each text and the end), and so for each round of samples, with numbers."""

    ids: np.ndarray
    first: np.ndarray
    #: (ids, firsts, log probabilities, inclusion probabilities, which texts have the sample)
    samples: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def segment_blocks(texts: pa.Array, keys: np.ndarray, ends: list[int], vocabulary: Vocabulary, samples: int = SAMPLES) -> Iterator[Segmented]:
    """Encodings and samples of texts, none null, a block of rows at a time (``ends`` has the blocks' ends); samples by falling perturbed value.

    A word's lattice is made once for each block that has it, or once for all of them if many have.
    """
    joined, lengths, words, first = word_places(texts, vocabulary)
    written, begins = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), _firsts(lengths)[:-1]
    spans = list(zip([0, *ends[:-1]], ends, strict=True))

    def found(a: int, b: int) -> np.ndarray:
        there = np.zeros(len(lengths), bool)
        there[words[first[a] : first[b]]] = True
        return there

    def made(some: np.ndarray) -> Lattice:
        return Lattice(written[_ranges(begins[some], lengths[some])], lengths[some], vocabulary)

    blocks = np.zeros(len(lengths), np.int32)
    for a, b in spans if len(spans) >= _OFTEN else []:
        blocks += found(a, b)
    often = np.flatnonzero(blocks >= _OFTEN)
    # No more at once than a block's words may have.
    pieces = np.split(often, np.flatnonzero(np.diff(np.cumsum(lengths[often]) // (_BATCH_CHARS // 2))) + 1) if len(often) else []
    shelf = Shelf(map(made, pieces))
    often_first, edges = shelf.likeliest() if len(often) else (np.zeros(1, np.int64), np.zeros(0, np.int64))
    often_ids, often_first = _spelled(shelf, edges, often_first, vocabulary) if len(often) else (np.zeros(0, np.int32), often_first)
    number = np.zeros(len(lengths), np.int64)
    number[often] = np.arange(len(often))
    for a, b in spans:
        there = found(a, b)
        there[often] = False
        own = np.flatnonzero(there)
        number[own] = len(often) + np.arange(len(own))
        lattice = made(own)
        # The encoding joins those of the words, each worked out once.
        own_first, edges = lattice.likeliest()
        own_ids, own_first = _spelled(lattice, edges, own_first, vocabulary)
        word_ids, word_first = np.concatenate([often_ids, own_ids]), np.concatenate([often_first, often_first[-1] + own_first[1:]])
        if len(often):
            shelf.put(lattice)
            lattice = shelf
        mine, at = number[words[first[a] : first[b]]], first[a : b + 1] - first[a]
        sizes = np.diff(word_first)[mine]
        out = Segmented(word_ids[_ranges(word_first[mine], sizes)], _firsts(sizes)[at], [])
        for paths, value, threshold in sample_segmentations(lattice, mine, at, keys[a:b], samples):
            ids, starts = _spelled(lattice, paths.edge, paths.first, vocabulary)
            with np.errstate(over="ignore", invalid="ignore"):
                inside = np.where(np.isneginf(threshold), 1.0, -np.expm1(-np.exp(np.minimum(paths.logp - threshold, 700))))
            out.samples.append((ids, starts, paths.logp, inside, value > -np.inf))
        yield out


def segment_all(texts: pa.Array, keys: np.ndarray, vocabulary: Vocabulary, samples: int = SAMPLES) -> Segmented:
    """Encodings and samples of texts, none null, as one block."""
    return next(segment_blocks(texts, keys, [len(texts)], vocabulary, samples))


def segment(texts: list[str], keys: np.ndarray, vocabulary: Vocabulary, samples: int = SAMPLES) -> list[tuple[np.ndarray, list[tuple[np.ndarray, float, float]]]]:
    """Of each text its encoding and its samples (ids, log probability, inclusion probability), by falling perturbed value."""
    found = segment_all(pa.array(texts, pa.string()), keys, vocabulary, samples)
    drawn = [[(ids[at[k] : at[k + 1]], float(logp[k]), float(inside[k])) for ids, at, logp, inside, has in found.samples if has[k]] for k in range(len(texts))]
    return [(found.ids[found.first[k] : found.first[k + 1]], drawn[k]) for k in range(len(texts))]


def _bytes_of(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    return (vocabulary.spelling.take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(ids) else b""


def decode(ids: np.ndarray | list[int], vocabulary: Vocabulary) -> str:
    """The text of an encoding or a sample: exactly what was encoded."""
    return _bytes_of(np.asarray(ids, np.int64), vocabulary).decode("utf-8", "surrogatepass")[1:]


SAMPLE_TYPE = "array<struct<ids: array<int>, log_probability: double, inclusion: double>>"
_SAMPLE = pa.struct([("ids", pa.list_(pa.int32())), ("log_probability", pa.float64()), ("inclusion", pa.float64())])


def _blocks(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, about so many characters of column text each."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + chars, "right")))
        yield batch.slice(a, b - a)
        a = b


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


def _columns(found: Segmented, null: np.ndarray) -> list[pa.Array]:
    """The columns ids and samples; ``null`` says which rows have none."""
    mask, n = pa.array(null), len(null)
    ids = pc.if_else(mask, None, _lists(found.ids, found.first))
    if not found.samples:
        return [ids, pc.if_else(mask, None, pa.array([[]] * n, pa.list_(_SAMPLE)))]
    every = pa.concat_arrays([_lists(i, at) for i, at, *_ in found.samples])
    logp, inside, has = (np.concatenate([s[k] for s in found.samples]) for k in (2, 3, 4))
    chosen = np.flatnonzero(has & ~np.tile(null, len(found.samples)))
    chosen = chosen[np.argsort(chosen % n, kind="stable")]
    structs = pa.StructArray.from_arrays([every.take(pa.array(chosen)), pa.array(logp[chosen]), pa.array(inside[chosen])], fields=list(_SAMPLE))
    samples = pa.ListArray.from_arrays(pa.array(_firsts(np.bincount(chosen % n, minlength=n)), pa.int32()), structs)
    return [ids, pc.if_else(mask, None, samples)]


def _round_trips(texts: list[str], found: Segmented, vocabulary: Vocabulary) -> np.ndarray:
    """Whether a text's encoding and all its samples decode to it."""
    good = np.ones(len(texts), bool)
    for ids, first, has in [(found.ids, found.first, good.copy()), *((s[0], s[1], s[4]) for s in found.samples)]:
        wanted = " ".join(t for t, h in zip(texts, has.tolist(), strict=True) if h and t)
        if _bytes_of(ids, vocabulary) != (b" " + wanted.encode() if wanted else b""):
            good &= [not h or decode(ids[a:b], vocabulary) == t for t, h, a, b in zip(texts, has.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return good


def encode_texts(docs: DataFrame, model: bytes | None = None, samples: int = SAMPLES, seed: int = SEED, key: str = "doc_id", check: bool = False) -> DataFrame:
    """docs with ids (array<int>) and samples (array of ids, log_probability, inclusion), which replace columns so named.

    With ``check`` also round_trip: whether the encoding and all samples decode
    to the text. Null texts have null ids, samples and round_trip. The empty
    text has one segmentation, without ids, and a lone sample, itself. Rows of
    equal key and text get equal samples; a null key is a key. Whole texts are
    segmented, a block of rows at a time. Other columns stay; an empty table
    gives no rows.
    """
    model, more = model or load(), f"ids array<int>, samples {SAMPLE_TYPE}{', round_trip boolean' if check else ''}"
    held = docs.drop("ids", "samples", *["round_trip"] * check)
    names = held.columns
    (hashed,) = unused(held, "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(model)
        for group in (g for batch in batches for g in _blocks(batch, _GROUP_CHARS)):
            parts = list(_blocks(group, _BATCH_CHARS))
            ends = np.cumsum([p.num_rows for p in parts]).tolist()
            filled, keys = pc.fill_null(group.column("text"), ""), group.column(hashed).to_numpy(zero_copy_only=False).astype(np.int64)
            for part, end, found in zip(parts, ends, segment_blocks(filled, keys, ends, vocabulary, samples), strict=True):
                null = part.column("text").is_null().to_numpy(zero_copy_only=False)
                told = _columns(found, null)
                if check:
                    told.append(pc.if_else(pa.array(null), None, pa.array(_round_trips(filled[end - part.num_rows : end].to_pylist(), found, vocabulary))))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *told], [*names, "ids", "samples", *["round_trip"] * check])

    return held.withColumn(hashed, F.xxhash64(F.col(key).cast("string"), F.lit(seed))).mapInArrow(run, widened(held, more))


def decode_ids(encoded: DataFrame, model: bytes | None = None, column: str = "ids") -> DataFrame:
    """encoded with the column ``decoded``: the text of the ids (array<int>) in ``column``; null for null."""
    model = model or load()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        vocabulary = _loaded(model)
        return pd.Series([None if x is None else decode(x, vocabulary) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text(column))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and samples of every document, each decoded again."""
    told = encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "samples", "round_trip")
