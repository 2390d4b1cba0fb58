"""Near copies by the share of word shingles they have in common, found through wide SimHash fingerprints.

Texts that share 0.8 of their shingles differ in about 15 % of their
fingerprint bits, too many for the exact search on 64 bits. So the fingerprint
has 512 bits, and the pigeonhole becomes one of probabilities: correlated bits
are put into the same partition, each partition gets its own threshold (not
probed, equal, or one bit apart), and dynamic programming picks the thresholds
of least estimated cost with which a pair of just the wanted similarity meets
in some partition with the wanted probability. Pairs that meet are verified by
the distance of the whole fingerprints, then by the shingles themselves.

That finds most groups, not all. What is left is found exactly: texts that
share enough of their shingles have one in common among their first few in any
one order of all shingles (the prefix filter). Rarer shingles come first, and
pairs that are in one group already are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, removed, stored, stored_at, unused
from tidemark.llm.simhash import shingle_hashes

LANES = 8
BITS, BLOCK = 64 * LANES, 4
WIDTHS = range(8, 41, BLOCK)
#: A row written and sorted costs about as much as so many comparisons.
ROW_COST = 400
#: Rows of one key that are compared in one piece; more are dealt into pieces, compared two by two.
PIECE = 1024
#: Texts whose shingles are counted, how many of them make a shingle common, and the most such shingles: these set an order, not what is found.
SAMPLED, COMMON, MOST = 1 << 14, 8, 1 << 16
#: Pairs that leave a task for each of its rows in the first round over the prefixes, and how many times that in each further one.
FIRST, GROWTH = 16, 8
#: Buckets of a sketch, twice as many over each of so many shingles; pairs of sketches compared at once; pairs that a task holds to tell repeated ones.
BUCKETS, LONG, CHUNK, HELD = 128, (1536, 4096), 1 << 12, 1 << 18
_LANE = np.arange(1, LANES + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """512 bits, each set if it is set in over half the distinct hashes; zero if there are none."""
    hashes, counts = np.unique(hashes), np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        mixed = hashes[at : at + 255, None] + _LANE
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def apart(similarity: float) -> float:
    """Share of bits in which texts of that similarity (Jaccard) differ at most, on average."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, LANES)


def _bits(column: pa.Array) -> np.ndarray:
    return np.unpackbits(_words(column).view(np.uint8), axis=1, bitorder="little")


def _summed(prints: DataFrame, tally, rows: int, columns: int) -> np.ndarray:  # noqa: ANN001
    """Sum over all fingerprints of a (rows, columns) table of counts; only that table reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += tally(_bits(batch.column(0)))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(rows), pa.int32()), "n": pa.array(list(total), pa.list_(pa.int64()))})

    out = np.zeros((rows, columns))
    for row in prints.select("print").mapInArrow(count, "i int, n array<long>").groupBy("i").agg(*(F.sum(F.col("n")[k]) for k in range(columns))).collect():
        out[row[0]] = row[1:]
    return out


def _together(bits: np.ndarray) -> np.ndarray:
    lanes = bits.astype(np.float32).reshape(-1, LANES, 64).transpose(1, 0, 2)
    return (lanes.transpose(0, 2, 1) @ lanes).reshape(BITS, 64).astype(np.int64)


def group_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """The bits of every lane in blocks of four, correlated bits together: each block grows from the first free bit."""
    blocks = []
    for lane in range(LANES):
        table = both[64 * lane : 64 * lane + 64]
        p = np.diag(table) / n
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        phi, free = np.abs(table / n - np.outer(p, p)) / np.outer(spread, spread), np.ones(64, bool)
        while free.any():
            block = [int(free.argmax())]
            free[block] = False
            while len(block) < BLOCK:
                block.append(int(np.where(free, phi[block].sum(axis=0), -1).argmax()))
                free[block] = False
            blocks.append([64 * lane + b for b in block])
    return blocks


def block_shares(prints: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    """Share of all pairs at each distance 0..4 within every block."""

    def tally(bits: np.ndarray) -> np.ndarray:
        values = np.packbits(bits[:, sum(blocks, [])].reshape(len(bits), len(blocks), BLOCK), axis=2, bitorder="little")[:, :, 0]
        return np.stack([np.bincount(v, minlength=1 << BLOCK) for v in values.T])

    values = np.arange(1 << BLOCK)
    distance = np.bitwise_count(values[:, None] ^ values).ravel()
    histograms = _summed(prints, tally, len(blocks), 1 << BLOCK)
    return [np.bincount(distance, weights=np.outer(h, h).ravel() / h.sum() ** 2, minlength=BLOCK + 1) for h in histograms]


def allocate(costs: list[list[tuple[int, float, float]]], miss: float) -> tuple[float, list[int]] | None:
    """Cheapest thresholds, one a partition, whose chances to miss multiply to at most ``miss``.

    costs holds the choices (threshold, cost, chance to miss) of every partition.
    Dynamic programming over the logarithm of the chance, in steps rounded down.
    """
    step = 0.02
    goal = math.ceil(-math.log(miss) / step)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for choices in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for reached, (cost, chosen) in best.items():
            for threshold, more, missed in choices:
                at = min(goal, reached + int(-math.log(missed) / step))
                if at not in grown or cost + more < grown[at][0]:
                    grown[at] = cost + more, [*chosen, threshold]
        best = grown
    return best.get(goal)


def plan_probes(prints: DataFrame, n: int, similarity: float, recall: float) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, from counts over all fingerprints."""
    shares = block_shares(prints, blocks := group_bits(_summed(prints, _together, BITS, 64), n))
    p, found = apart(similarity), None
    for width in WIDTHS:
        each, parts, costs = width // BLOCK, [], []
        for at in range(0, len(blocks) - each + 1, each):
            share = np.ones(1)
            for s in shares[at : at + each]:
                share = np.convolve(share, s)
            choices, missed = [(-1, 0.0, 1.0)], 1.0
            for t in (0, 1):
                missed -= math.comb(width, t) * p**t * (1 - p) ** (width - t)
                choices.append((t, n * n / 2 * share[: t + 1].sum() * (1 + t) + ROW_COST * n * (1 + t * (width + 1)), missed))
            parts.append(sorted(sum(blocks[at : at + each], [])))
            costs.append(choices)
        plan = allocate(costs, 1 - recall)
        if plan and (found is None or plan[0] < found[0]):
            found = plan[0], [(bits, t) for bits, t in zip(parts, plan[1], strict=True) if t >= 0]
    assert found is not None
    return found[1]


def spanning_forest(u: np.ndarray, v: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges (u, v, distance d) of a least spanning forest over nodes 0..n-1."""
    place, comp, chosen = np.argsort(d, kind="stable"), np.arange(n), []
    while True:
        a, b = comp[u[place]], comp[v[place]]
        place, a, b = place[a != b], a[a != b], b[a != b]
        if not len(place):
            return np.array(chosen, np.int64)
        first = np.full(n, len(place))
        np.minimum.at(first, a, np.arange(len(place)))
        np.minimum.at(first, b, np.arange(len(place)))
        parent = np.arange(n)
        for k in np.unique(first[first < len(place)]):
            x, y = int(a[k]), int(b[k])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append(place[k])
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        comp = parent[comp]


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    distance = np.zeros((len(x), len(y)), np.uint16)
    for k in range(LANES):
        distance += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    i, j = np.nonzero(distance <= limit)
    return i, j, distance[i, j]


def _grouped(edges, columns):  # noqa: ANN001, ANN202
    """The edges (src, dst) of every (key, i, j), the first columns; rows come sorted by these.

    A pair that meets under many keys of a task leaves it once for every HELD pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def once() -> pa.RecordBatch:
            src, dst = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
            order = np.lexsort((dst, src))
            src, dst = src[order], dst[order]
            new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]
            return pa.RecordBatch.from_pydict({"src": src[new], "dst": dst[new]})

        def found(rows: list[np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal many
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                if b - a > 1:
                    held.append(edges([x[a:b] for x in rows]))
                    many += len(held[-1][0])
                if many >= HELD or len(held) >= HELD:
                    yield once()
                    held.clear()
                    many = 0

        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = columns(batch)
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            key, i, j = rows[:3]
            ends = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(ends):  # the last group may go on in the next batch
                yield from found(rows, ends)
                rows = [x[ends[-1] :] for x in rows]
            rest = rows
        if rest is not None:
            yield from found(rest, np.array([len(rest[0])]))
        yield once()

    return compare


def _compare(limit: int):  # noqa: ANN202
    """Edges of a least spanning forest over the near pairs of every (key, i, j); rows come sorted by these."""

    def edges(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, piece, probe, ids, prints = rows
        mine, held = piece == i, ~probe
        pairs = [(mine & held, np.ones(len(ids), bool))] if i[0] == j[0] else [(mine & held, ~mine), (~mine & held, mine & probe)]
        u, v, d = [], [], []
        for x, y in pairs:
            x, y = np.flatnonzero(x), np.flatnonzero(y)
            a, b, c = _near(prints[x], prints[y], limit)
            u, v, d = [*u, x[a]], [*v, y[b]], [*d, c]
        u, v, d = map(np.concatenate, (u, v, d))
        known, at = np.unique(ids, return_inverse=True)
        differ = at[u] != at[v]
        u, v, d = at[u[differ]], at[v[differ]], d[differ]
        kept = spanning_forest(u, v, d, len(known))
        return known[np.minimum(u[kept], v[kept])], known[np.maximum(u[kept], v[kept])]

    return _grouped(edges, lambda batch: [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [_words(batch.column(6))])


def _keys(plan: list[tuple[list[int], int]]):  # noqa: ANN202
    """For every fingerprint the keys it is held under, then those it probes one bit apart."""
    powers = [np.int64(1) << np.arange(len(bits), dtype=np.int64) for bits, _ in plan]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits, held, probes = _bits(batch.column(1)), [], [np.zeros((batch.num_rows, 0), np.int64)]
            for k, (some, threshold) in enumerate(plan):
                held.append((k << 48) + bits[:, some].astype(np.int64) @ powers[k])
                if threshold:
                    probes.append(held[-1][:, None] ^ powers[k])
            lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (np.stack(held, axis=1), np.concatenate(probes, axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "print", "held", "probes"])

    return keys


def candidate_links(prints: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """Pairs (src, dst) of ids that join near fingerprints into groups; prints has (id, print), all distinct.

    Of the near pairs within one key a least spanning forest is returned, so
    that a large group of near copies gives as many rows as it has members.
    """
    n, p = prints.count(), apart(similarity)
    if n < 2:
        return prints.sparkSession.createDataFrame([], "src long, dst long")
    plan = plan_probes(prints, n, similarity, recall)
    # Five standard deviations over the mean: what is over this is no near copy.
    limit = math.ceil(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))
    rows = prints.select("id", "print").mapInArrow(_keys(plan), "id long, print binary, held array<long>, probes array<long>")
    rows = rows.select("id", "print", F.explode(F.concat(F.transform("held", lambda k: F.struct(k.alias("key"), F.lit(False).alias("probe"))), F.transform("probes", lambda k: F.struct(k.alias("key"), F.lit(True).alias("probe"))))).alias("at")).select("id", "print", "at.key", "at.probe")
    # The keys are worked out twice rather than stored: they are several times the fingerprints.
    # A key that no second row has gives no pair. Stored, the sizes are known: while they are small, no fingerprint moves to meet them.
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "sizes")
    dealt = rows.join(sizes, "key").withColumn("piece", F.pmod(F.xxhash64("id", "probe"), "pieces").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("key", F.least("piece", "with").alias("i"), F.greatest("piece", "with").alias("j"), "piece", "probe", "id", "print")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(limit), "src long, dst long").distinct()


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that many texts have, by rising number; counted in a sample of docs (text), so a matter of cost alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                hashes = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(hashes).view(np.int64)})

    n = docs.count()
    some = docs.select("text").sample(SAMPLED / n, seed=1) if n > SAMPLED else docs.select("text")
    counts = some.mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.array([r["shingle"] for r in counts.orderBy(F.desc("n"), "shingle").limit(MOST).collect()][::-1], np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first distinct shingles in an order that puts common ones last: so many that texts of that similarity share one."""
    by_hash = np.argsort(common)
    at = np.searchsorted(common[by_hash], shingles)
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = by_hash[np.minimum(at, len(common) - 1)]
        rank = np.where(common[at] == shingles, at + 1, 0)
    least = math.ceil(similarity * len(shingles) - 1e-9)
    return shingles[np.lexsort((shingles, rank))[: len(shingles) - least + 1]]


def bitmap(shingles: np.ndarray) -> bytes:
    """A set of distinct shingles by their last bits, about four to eight bits for each."""
    bits = np.zeros(max(64, 1 << (4 * len(shingles) - 1).bit_length() if len(shingles) else 64), bool)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_share(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """Whether sets of n and m shingles can have that similarity: a bit that only one has is a shingle that only it has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = _folded(x, size), _folded(y, size)
    both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return both >= similarity / (1 + similarity) * (n + m) - 1e-9


def sketch(shingles: np.ndarray) -> bytes:
    """Numbers of a set's distinct shingles by bucket, modulo 16, two a byte."""
    buckets = BUCKETS << sum(len(shingles) > most for most in LONG)
    counts = (np.bincount((shingles >> np.uint64(32) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def least_apart(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the places a and b of sketches how many shingles only one of the two sets has, at least: by bucket what the numbers differ by."""
    most = BUCKETS << len(LONG)
    raw = np.frombuffer(b"".join(x.ljust(most // 2, b"\0") for x in sketches), np.uint8).reshape(-1, most // 2)
    wide, sizes = np.stack([raw & 15, raw >> 4], axis=2).reshape(-1, most), 2 * np.array([len(x) for x in sketches], np.int64)
    out, common = np.empty(len(a), np.int64), np.minimum(sizes[a], sizes[b])
    for size in np.unique(common):
        # A sketch of more buckets becomes one of fewer by adding those that agree in the last bits.
        which, counts = np.flatnonzero(common == size), wide.reshape(len(wide), -1, size).sum(axis=1, dtype=np.uint8)
        for at in range(0, len(which), CHUNK):
            some = which[at : at + CHUNK]
            more = (counts[a[some]] - counts[b[some]]) & 15
            out[some] = np.minimum(more, 16 - more).sum(axis=1, dtype=np.int64)
    return out


def _possible(similarity: float):  # noqa: ANN202
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(k).to_pylist() for k in range(2, 6))
            kept = [may_share(*x, similarity) for x in zip(a, b, n, m, strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(kept, pa.bool_()))

    return possible


def _fingerprints(width: int, similarity: float, common: np.ndarray):  # noqa: ANN202
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, firsts, maps, sketches = [], [], [], [], []
            for t in batch.column(2):
                hashes = np.unique(shingle_hashes(t.as_py(), width))
                prints.append(wide_fingerprint(hashes))
                sizes.append(len(hashes))
                firsts.append(prefix(hashes.view(np.int64), common, similarity))
                maps.append(bitmap(hashes))
                sketches.append(sketch(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "tie", "print", "size", "prefix", "bitmap", "sketch"])

    return fingerprints


def _meet(similarity: float, share: int):  # noqa: ANN202
    """Pairs of a (key, i, j) that may be similar and are in two components; a pair (-1, -1) says that some were held back."""

    def edges(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, piece, component, size, at, ids, sketches = rows
        x = np.flatnonzero(piece == i)
        y = x if i[0] == j[0] else np.flatnonzero(piece != i)
        # Where the shingle is the first that both have, so many can be common at most; fewer than the similarity asks are too few.
        most = size - at
        a, b = np.nonzero((component[x][:, None] != component[y]) & (np.minimum(most[x][:, None], most[y]) >= similarity / (1 + similarity) * (size[x][:, None] + size[y]) - 1e-9))
        a, b = x[a], y[b]
        if y is x:
            a, b = a[ids[a] < ids[b]], b[ids[a] < ids[b]]
        if len(a):
            near = least_apart(sketches.tolist(), a, b) <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-9
            a, b = a[near], b[near]
        src, dst = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        if len(src) > share * len(ids):
            mixed = (src * np.int64(0x1E3779B97F4A7C15)) ^ (dst * np.int64(0x3F58476D1CE4E5B9))
            some = np.argpartition(mixed ^ (mixed >> np.int64(31)), share * len(ids))[: share * len(ids)]
            src, dst = np.append(src[some], -1), np.append(dst[some], -1)
        return src, dst

    return _grouped(edges, lambda batch: [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)])


def shared_prefixes(texts: DataFrame) -> DataFrame:
    """(key, id, size, at) of every shingle in the prefixes of two or more texts (id, size, prefix), stored.

    Most shingles of a prefix are in one text alone. They are counted with
    nothing beside them, and where the shared ones are few the rest never moves.
    """
    rows = texts.select("id", "size", F.posexplode("prefix").alias("at", "key"))
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    return stored(rows.join(shared, "key").select("key", "id", "size", F.col("at").cast("long").alias("at")), "prefixes")


def prefix_links(shared: DataFrame, components: DataFrame, sketches: DataFrame, similarity: float, share: int) -> DataFrame:
    """Pairs (src, dst) of ids in two components that share a shingle of their prefixes and can be similar by their sketches.

    shared is what shared_prefixes gives, components (node, component); an id
    without one is its own; sketches has (id, sketch) of all. A task gives
    ``share`` pairs a row at most. If it had more, (-1, -1) is among the pairs.
    Sketches meet only the rows of shingles that two components share.
    """
    rows = shared.join(components, shared["id"] == components["node"], "left").select("key", "id", "size", "at", F.coalesce("component", "id").alias("component"))
    # A key all of whose rows are in one component joins nothing more.
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    met = rows.join(stored(sizes, "sizes"), "key").join(sketches, "id")
    dealt = met.withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("key", F.least("piece", "with").alias("i"), F.greatest("piece", "with").alias("j"), "piece", "component", "size", "at", "id", "sketch")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet(similarity, share), "src long, dst long").distinct()


def _shingles(width: int):  # noqa: ANN202
    """The distinct shingles of texts (id, text); few texts at a time."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(k).slice(at, 256) for k in range(2))
                sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_pydict({"id": ids, "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return shingles


def _tie() -> Column:
    """Tells texts apart; null is as the empty text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _of_both(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of texts (id, ...) that some link (src, dst) names. The ids are stored, so that a few don't move all texts."""
    return texts.join(stored(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "named"), "id", "left_semi")


def verified(links: DataFrame, docs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The links (src, dst) whose texts share ``similarity`` of their distinct shingles or more.

    Most that don't are told by their bitmaps, a sixteenth of the shingles in
    size; only the others' shingles are fetched. texts has (id, doc_id, tie,
    size, bitmap) of the rows of docs, those at least that links names.
    """
    at = _of_both(links, texts.select("id", "size", "bitmap"))
    likely = links.join(at.withColumnsRenamed({"id": "src", "size": "n", "bitmap": "a"}), "src").join(at.withColumnsRenamed({"id": "dst", "size": "m", "bitmap": "b"}), "dst")
    links, some = stored_at(likely.select("src", "dst", "a", "b", "n", "m").mapInArrow(_possible(similarity), "src long, dst long"), "likely")
    wanted = stored(_of_both(links, texts.select("id", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))), "wanted")
    slim = docs.select("doc_id", "text", _tie().alias("tie"))
    named = slim.join(wanted, slim["doc_id"].eqNullSafe(wanted["_id"]) & (slim["tie"] == wanted["_tie"])).select("id", "text")
    # A repeated row gives its shingles twice, and so a link twice.
    sets, folder = stored_at(named.mapInArrow(_shingles(width), "id long, shingles array<long>"), "shingles")
    pairs = links.join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst")
    both = F.size(F.array_intersect("a", "b"))
    sure = stored(pairs.where(both / (F.size("a") + F.size("b") - both) >= similarity).select("src", "dst").distinct(), "verified")
    removed(docs.sparkSession, some, folder)
    return sure


def group_texts(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (doc_id, tie, print) of docs, texts (print, component, first, ...) of its distinct prints.

    ``first`` (none, doc_id, tie, id) names the first row with that print: rows
    without doc_id come last, then it goes by doc_id, then by the text's hash.
    Bitmaps are stored once, by rows. The first row brings its prefix and sketch along, so that no row is looked up by the prints.
    """
    common = common_shingles(docs, width)
    marked = docs.select("doc_id", _tie().alias("tie"), "text").mapInArrow(_fingerprints(width, similarity, common), "doc_id long, tie long, print binary, size long, prefix array<long>, bitmap binary, sketch binary")
    marked = stored(marked.withColumn("id", F.monotonically_increasing_id()), "prints")
    first = marked.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "id", "size", "prefix", "sketch")).alias("f"))
    every = stored(first.select("f.id", "print", F.struct("f.none", "f.doc_id", "f.tie", "f.id").alias("first"), "f.size", "f.prefix", "f.sketch"), "distinct")
    prints, shared = every.select("id", "print", "first"), shared_prefixes(every.select("id", "size", "prefix"))

    sure, share, held = verified(stored(candidate_links(prints, similarity, recall), "candidates"), docs, marked, similarity, width), FIRST, True
    components = stored(connected_components(sure), "components")
    while held:
        links, folder = stored_at(prefix_links(shared, components, every.select("id", "sketch"), similarity, share), "candidates")
        held = not links.where("src < 0").isEmpty()
        sure = sure.unionByName(verified(links.where("src >= 0"), docs, marked, similarity, width))
        removed(docs.sparkSession, folder)
        components, share = stored(connected_components(sure), "components"), share * GROWTH
    named = prints.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return marked.select("doc_id", "tie", "print"), named


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.99) -> DataFrame:
    """(doc_id, component_id) of every row of docs (doc_id, text): the least doc_id that links of ``similarity`` or more reach.

    The similarity of two texts is the share of their distinct word shingles
    that both have. Every link is verified on the shingles. The fingerprints
    find a pair of just that similarity with probability ``recall``; all pairs
    between the groups that come of it are then found by their prefixes, in
    rounds, until no task holds a pair back. Texts without a word
    (null ones too) are copies of each other. Rows without doc_id get the
    component of their text but never name one, unless all of it are such: it
    is null then. Repeated rows are returned as often as they come, other
    columns are ignored, an empty table gives no rows.
    """
    rows, named = group_texts(docs, similarity, width, recall)
    least = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    return rows.join(named.join(least, "component").select("print", "component_id"), "print").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of docs for each group of near copies, all columns kept: the first by doc_id, then by the text's hash.

    Rows without doc_id come after all others, so a group of such rows leaves
    one too. Rows that share a doc_id are told apart by their texts; of those
    equal in both an arbitrary one stays. Null and wordless texts are one group.
    """
    rows, named = group_texts(docs, similarity, width)
    # The groups' first rows come by aggregates alone, so a large group is no large task. Stored, their size is known:
    # while it is small, Spark leaves the texts where they are.
    leaders = stored(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie")), "leaders")
    (tie,) = unused(docs, "_text")
    held = docs.withColumn(tie, _tie())
    kept = held.join(leaders, held["doc_id"].eqNullSafe(leaders["_id"]) & (held[tie] == leaders["_tie"]), "left_semi")
    # Only where some rows repeat do texts have to be sorted by them.
    repeats = not rows.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()
    return (kept.dropDuplicates(["doc_id", tie]) if repeats else kept).drop(tie)
