"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits recursively at a random direction near the median projection
of a bounded sample; a vector within ``spill`` of a split goes both ways, so
near pairs seldom part. All vectors are indexed. Pairs are compared within the
leaves of every tree, verified by exact cosine, counted once, and united.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, read, stored

THRESHOLD, TREES, LEAF, SAMPLE, BLOCK, SEED = 0.93, 5, 192, 8192, 512, 11


def fit_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of the inner nodes in heap order; a node with under 8 sample rows has cut nan: a leaf."""
    nodes, width = (1 << depth) - 1, sample.shape[1] if sample.ndim == 2 else 0
    directions, cuts = rng.standard_normal((nodes, width)), np.full(nodes, np.nan)
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)
    at = {0: np.arange(len(sample))}
    for node in range(nodes):
        rows = at.pop(node, np.empty(0, np.int64))
        if len(rows) >= 8:
            p = sample[rows] @ directions[node]
            cuts[node] = np.median(p)
            at[2 * node + 1], at[2 * node + 2] = rows[p <= cuts[node]], rows[p > cuts[node]]
    return directions, cuts


def leaves_of(unit: np.ndarray, directions: np.ndarray, cuts: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of every leaf that a row falls into; leaves are nodes of the heap."""
    rows, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        inner = node < len(cuts)
        inner[inner] &= ~np.isnan(cuts[node[inner]])
        done.append((rows[~inner], node[~inner]))
        rows, node = rows[inner], node[inner]
        p = np.einsum("ij,ij->i", unit[rows], directions[node]) - cuts[node]
        low, high = p <= spill, p >= -spill
        rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
    return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def _matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _earlier(leaf: int, mine: pd.Series, other: pd.Series) -> np.ndarray:
    """Whether a row of mine and one of other meet in a leaf before this one."""
    lists = [x[x < leaf] for x in (np.asarray(v) for v in [*mine, *other])]
    known, at = np.unique(np.concatenate(lists), return_inverse=True)
    has = np.zeros((len(lists), len(known)), np.float32)
    has[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), at] = 1
    return has[: len(mine)] @ has[len(mine) :].T > 0


def _compare(threshold: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, leaf, i, j = key
        rows = rows.sort_values("rep")
        a = rows if i == j else rows[rows["block"] == i]
        b = rows if i == j else rows[rows["block"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        x, y = _matrix(a["embedding"]), _matrix(b["embedding"])
        linked = (x @ y.T >= threshold) & ~_earlier(leaf, a["leaves"], b["leaves"])
        if i == j:
            np.fill_diagonal(linked, False)
        out = [(a["rep"].to_numpy(), linked @ b["n"].to_numpy())]
        if i != j:
            out.append((b["rep"].to_numpy(), linked.T @ a["n"].to_numpy()))
        ra, rb = a["rep"].to_numpy().copy(), b["rep"].to_numpy().copy()
        while True:  # least id of each local component
            least = lambda m, own, far: np.minimum(own, np.where(m, far[None, :], np.iinfo(np.int64).max).min(axis=1))
            na = least(linked, ra, rb)
            nb = na if i == j else least(linked.T, rb, na)
            if np.array_equal(na, ra) and np.array_equal(nb, rb):
                break
            ra, rb = na, nb
        roots = [ra] if i == j else [ra, rb]
        found = pd.DataFrame({"rep": np.concatenate([r for r, _ in out]), "links": np.concatenate([c for _, c in out]), "root": np.concatenate(roots)})
        return found[found["links"] > 0]

    return compare


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors are compared if labels and lengths are equal. Rows whose label,
    vec_id or embedding is null, and vectors that are empty, zero or hold null
    or non-finite components, link with nothing and are their own component.
    Equal vectors are held as one with a count. Repeated rows link with each
    other like other equal vectors. An empty table gives no rows; other columns
    are ignored.

    The split points come from about ``sample`` vectors (all, if fewer); the
    trees' depth follows the largest label so that leaves hold about ``leaf``
    vectors. A leaf of more is compared block by block in tasks of two blocks.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = stored(vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))), "vectors")
    distinct = stored(rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("dims", F.size("embedding")), "distinct")
    # One number a label and length; only the largest and the total reach the driver.
    most, total, width = distinct.groupBy("label", "dims").count().agg(F.max("count"), F.sum("count"), F.max("dims")).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    depth = max(0, math.ceil(math.log2(most / leaf)))
    every = max(1, total // sample)
    # About ``sample`` vectors reach the driver.
    fitted = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("embedding").toPandas()["embedding"]
    rng = np.random.default_rng(seed)
    points = _matrix(fitted, width) if len(fitted) else np.zeros((0, width))
    forest = [fit_tree(points, depth, rng) for _ in range(trees)]
    # Half the root mean square of what a just linked pair differs by along a random direction.
    spill = 0.5 * math.sqrt(2 - 2 * threshold) / math.sqrt(max(width, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("embedding").to_pandas(), width)
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for t, (directions, cuts) in enumerate(forest):
                for r, node in zip(*(x.tolist() for x in leaves_of(unit, directions, cuts, spill)), strict=True):
                    found[r].append(t << 40 | node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    placed = stored(distinct.mapInArrow(place, "label string, embedding array<double>, rep long, n long, dims int, leaves array<long>"), "placed")
    at = placed.withColumn("leaf", F.explode("leaves"))
    key = ["label", "dims", "leaf"]
    sizes = placed.select("label", "dims", F.explode("leaves").alias("leaf")).groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    at = at.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    at = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    found = stored(at.groupBy(*key, "i", "j").applyInPandas(_compare(threshold), "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    named = distinct.join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("fine").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(src, dst) AS (SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src),
least AS (SELECT src, min(dst) AS dst FROM reach GROUP BY src), counts AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(dst, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(dst, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.src = vec_id LEFT JOIN counts ON counts.src = vec_id
"""
