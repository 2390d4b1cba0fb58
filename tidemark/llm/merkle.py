"""A Merkle manifest of a dataset: digests of rows, trees over sources, proofs, and what tampering does to them.

A node's digest is the lowercase hex SHA-256 of its children's hex digests. Up
to 16 consecutive nodes share a parent, so how many children a parent waits for
follows from the number of leaves alone. A partial parent collects children by
their index and is emitted, itself a child of the next parent, when the last one
arrives. A first pass does this inside the sorted partitions, as a map-side
combine; only the children of parents that no partition completed are shuffled,
to ever wider blocks of leaves, until each tree has its root. Parents keep their
children's digests: these reverse links, dealt to blocks of 256 leaves, give
every leaf its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import number_rows, partitions, read, stored

#: Children of a full parent, as bits of a place.
BITS = 4
ARITY = 1 << BITS
#: Levels of links that a block of leaves holds of its own: 256 leaves.
BLOCK = 2
TAMPERED = 5
NODE = "grp long, level int, place long, n long, digest binary, children binary, open boolean"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(text: Column) -> Column:
    """A row's digest, with the given text: of doc_id, source, lang, n_chars and text, lengths in front, ``-`` for null."""
    parts = []
    for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text):
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (grp, level, place, n, digest) to finished parents, and the nodes whose parent lacks a child (``open``).

    n is the tree's number of leaves. What is held is the children of parents
    not yet complete: with rows in order few a level, at most a partition.
    """
    schema = pa.schema([("grp", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("children", pa.binary()), ("open", pa.bool_())])
    waiting: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        out = []
        for grp, level, place, n, digest in zip(*(batch.column(c).to_pylist() for c in ("grp", "level", "place", "n", "digest")), strict=True):
            if n == 1:
                out.append((grp, 0, 0, 1, digest, None, False))
            while (width := -(-n // ARITY**level)) > 1:
                parent = place // ARITY
                _, held = waiting.setdefault((grp, level, parent), (n, {}))
                held[place % ARITY] = digest
                due = min(ARITY, width - ARITY * parent)
                if len(held) < due:
                    break
                del waiting[grp, level, parent]
                children = b"".join(held[k] for k in range(due))
                level, place, digest = level + 1, parent, hashlib.sha256(children.hex().encode()).digest()
                out.append((grp, level, place, n, digest, children, False))
        if out:
            yield batch_of(out)
    for (grp, level, parent), (n, held) in waiting.items():
        yield batch_of([(grp, level, ARITY * parent + k, n, d, None, True) for k, d in held.items()])


def tree(leaves: DataFrame) -> DataFrame:
    """All parents (NODE's columns) of trees over leaves (grp, place, n, digest); a lone leaf is its tree's root, at level 0.

    places are 0 to n - 1 in each grp. Every round shuffles the open nodes alone:
    to blocks of leaves sixteen times sixteen as wide as the round before, each
    of which then has one open node left.
    """
    spark = leaves.sparkSession
    nodes = stored(leaves.select("grp", F.lit(0).alias("level"), "place", "n", "digest").mapInArrow(climb, NODE), "nodes")
    done, reach = nodes.where("not open"), 0
    while (left := nodes.where("open").agg(F.count("*"), F.max("level")).first())[0]:
        # A block holds some 256 partitions' open nodes in the first round, 256 nodes in later ones.
        reach = max(reach + 2, left[1] + 1)
        shift = BITS * (F.lit(reach) - F.col("level"))
        wide = nodes.where("open").withColumn("_block", F.when(shift > 0, F.call_function("shiftright", "place", shift)).otherwise(F.call_function("shiftleft", "place", -shift)))
        wide = wide.repartition(partitions(spark), "grp", "_block").sortWithinPartitions("grp", "_block", "level", "place")
        nodes = stored(wide.select("grp", "level", "place", "n", "digest").mapInArrow(climb, NODE), "nodes")
        done = done.unionByName(nodes.where("not open"))
    return done


def _is_root() -> Column:
    return (F.col("place") == 0) & (F.call_function("shiftleft", F.lit(1).cast("long"), BITS * F.col("level")) >= F.col("n"))


def _dealt(links: DataFrame, bits: int) -> DataFrame:
    """Links (of level 1 and up) with every block of 2^bits leaves below them: one block for low links, all for high ones."""
    up = BITS * F.col("level") - bits
    last = F.least(F.call_function("shiftleft", F.col("place") + 1, F.greatest(up, F.lit(0))) - 1, F.call_function("shiftright", F.col("n") - 1, F.lit(bits)))
    high = F.explode(F.sequence(F.call_function("shiftleft", "place", F.greatest(up, F.lit(0))), last))
    return links.where("level > 0").select("*", F.when(up > 0, F.lit(None)).otherwise(F.call_function("shiftright", "place", F.greatest(-up, F.lit(0)))).alias("_low"), F.when(up > 0, F.lit(True)).otherwise(F.lit(False)).alias("_high")).transform(
        lambda d: d.where("not _high").withColumn("block", F.col("_low")).unionByName(d.where("_high").withColumn("block", high)).drop("_low", "_high")
    )


def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves to PROVED's columns; rows come by (grp, block), a block's links (tree 0: source, 1: sources) before its leaves."""
    at, links, tops = None, {}, ()
    names = [x.split()[0] for x in PROVED.split(", ")]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for batch in batches:
        out = []
        for grp, block, over, level, place, digest, children, doc_id, leaf, seen in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "over", "level", "place", "digest", "children", "doc_id", "leaf", "seen")), strict=True):
            if at != (grp, block):
                at, links, tops = (grp, block), {}, [(0, None), (0, None)]
            if over is not None:
                links[over, level, place] = children
                tops[over] = max(tops[over], (level, digest), key=lambda x: x[0])
                continue
            fold, proof = seen, hashlib.sha256()
            for kind, index in ((0, place), (1, grp)):
                rise = 1
                while (kids := links.get((kind, rise, index // ARITY))) is not None:
                    k = 32 * (index % ARITY)
                    proof.update((kids[:k] + kids[k + 32 :]).hex().encode())
                    fold = hashlib.sha256((kids[:k] + fold + kids[k + 32 :]).hex().encode()).digest()
                    rise, index = rise + 1, index // ARITY
            subroot = tops[0][1] or leaf
            root = tops[1][1] or subroot
            out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), proof.hexdigest(), fold.hex(), fold == root))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def tampered_text() -> Column:
    """The query's tampering: A-Z of the text in lower case where 5 divides the id's CRC."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def manifest(docs: DataFrame, tampered: Callable[[], Column] = tampered_text) -> DataFrame:
    """Every row of docs (doc_id, source, lang, n_chars, text) with its leaf, roots, proof digest and a check after tampering.

    ``tampered`` gives the text that is read again later; its leaf is folded with
    the original siblings. Rows of a source stand by doc_id, nulls first, then by
    leaf; equal rows are leaves of their own. Null values hash as ``-``, apart
    from empty texts; null sources are a tree of their own. A null doc_id is not
    tampered with by the query's rule. An empty table gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text").select(
        # "-" stands before "=": null first, then bytewise.
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"), leaf_digest(F.col("text")).alias("leaf"), leaf_digest(tampered()).alias("seen"),
    )
    # Stored first: the range partitioning's sampling would hash all texts a second time.
    base = stored(base, "leaves")
    order, at = ["key", "doc_id", "leaf"], F.monotonically_increasing_id()
    placed = stored(
        base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", at).withColumns({"part": F.shiftright("_at", 33), "pos": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"),
        "placed",
    )
    # A source's runs: one row for each partition that it reaches into.
    of = Window.partitionBy("key")
    runs = placed.groupBy("part", "key").agg(F.count("*").alias("c"), F.min("pos").alias("lo"))
    runs = stored(runs.select("part", "key", "lo", F.coalesce(F.sum("c").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("c").over(of).alias("n")), "runs")
    sources = number_rows(runs.groupBy("key").agg(F.max("n").alias("n")), ["key"], "grp")
    leaves = placed.join(runs.join(sources.select("key", "grp"), "key"), ["part", "key"]).select("part", "grp", (F.col("pos") - F.col("lo") + F.col("first")).alias("place"), "n", "doc_id", "leaf", "seen")
    links = tree(leaves.withColumnRenamed("leaf", "digest").sortWithinPartitions("part", "grp", "place"))
    subroots = links.where(_is_root()).select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.lit(sources.count()).cast("long").alias("n"), "digest")
    over = tree(subroots.coalesce(partitions(spark)))
    deal = BITS * BLOCK
    low = _dealt(links, deal).select("grp", "block", F.lit(0).alias("over"), "level", "place", "digest", "children")
    # A source's links in the tree of sources go to each of its blocks.
    high = _dealt(over, 0).select(F.col("block").alias("grp"), "level", "place", "digest", "children").join(sources.select("grp", "n"), "grp")
    high = high.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftright", F.col("n") - 1, F.lit(deal)))).alias("block"), F.lit(1).alias("over"), "level", "place", "digest", "children")
    rows = leaves.select("grp", F.call_function("shiftright", "place", F.lit(deal)).alias("block"), "place", "doc_id", "leaf", "seen")
    return low.unionByName(high).unionByName(rows, True).repartition(partitions(spark), "grp", "block").sortWithinPartitions("grp", "block", F.col("over").asc_nulls_last()).mapInArrow(prove, PROVED)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def _sql(levels: int = 5, over: int = 3) -> str:
    """The same for up to 16^levels rows a source and 16^over sources."""
    value = "coalesce(strlen({0}) || ':' || {0}, '-')"
    leaf = "sha256(" + " || ".join(value.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"d AS (SELECT doc_id, source, {leaf.format(text='text')} AS leaf, {leaf.format(text=f'CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE text END')} AS seen FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, leaf AS up, seen AS fold, '' AS proof FROM d)",
    ]
    for k in range(levels + over):
        if k == levels:  # from here on a source is a leaf
            steps.append(f"t{k}s AS (SELECT * REPLACE (0 AS grp, grp AS place, (SELECT max(grp) + 1 FROM t{k}) AS n), up AS subroot FROM t{k})")
        now = f"t{k}s" if k == levels else f"t{k}"
        steps.append(
            f"k{k} AS (SELECT grp, place // 16 AS place, list(up ORDER BY place) AS kids FROM (SELECT DISTINCT grp, place, up FROM {now}) GROUP BY ALL)"
        )
        steps.append(
            f"t{k + 1} AS (SELECT t.* REPLACE (t.place // 16 AS place, (t.n + 15) // 16 AS n, CASE WHEN t.n > 1 THEN sha256(array_to_string(kids, '')) ELSE up END AS up,"
            f" CASE WHEN t.n > 1 THEN sha256(array_to_string(kids[1:t.place % 16], '') || fold || array_to_string(kids[t.place % 16 + 2:], '')) ELSE fold END AS fold,"
            f" CASE WHEN t.n > 1 THEN proof || array_to_string(kids[1:t.place % 16], '') || array_to_string(kids[t.place % 16 + 2:], '') ELSE proof END AS proof)"
            f" FROM {now} t JOIN k{k} ON t.grp = k{k}.grp AND t.place // 16 = k{k}.place)"
        )
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, up AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = up AS verified FROM t{levels + over}"


OP13_SQL = _sql()
