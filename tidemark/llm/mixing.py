"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all reweightings of the tokens, the mix nearest to the corpus in relative
entropy that takes ``target`` words of every source, and whose words lie in
documents of the same lengths as the corpus's words do, gives each document the
rate exp(lambda of its source + sum of beta_k * moment k of its log length), no
rate above ``most``. The convex dual in lambda and beta is solved by Newton
steps. Each is one distributed aggregate over (source, size) cells: gradient and
Hessian by source, joined to one small system in beta (the sources are
eliminated first), after which every source's lambda follows by itself.

Sources' targets are exact constraints. The length moments are soft ones, with a
quadratic penalty in the dual, as capped sources can make exact ones impossible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, number_rows, read, stored

MAX_COPIES, WEIGHTS = 3, (1.0, 2.0, 3.0)
#: Least relative residual of a source at which Newton's method stops, its most steps, and the share of all words that beta = 1 costs.
RESIDUAL, STEPS, PENALTY = 1e-7, 30, 0.02
#: Rounds that give or take single copies after the first rounding.
REPAIRS = 6
#: Sums are of decimals, so that they don't depend on their order and reruns agree.
_EXACT = "decimal(38,10)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _total(x: Column) -> Column:
    return F.sum(x.cast(_EXACT)).cast("double")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, docs, target): shares of all words by weight, capped at ``most`` times the source.

    Sources in code point order, null last, have the weights in turn. A capped
    source's excess is shared again by weight until none is above its cap. Each
    round of sharing is one aggregate over the sources, of which two numbers
    reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    totals = number_rows(totals, [F.col("source").asc_nulls_last()], "_turn")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_turn") % len(weights) + 1).cast("int"))
    totals = stored(totals.withColumn("weight", weight), "sources")
    every = totals.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * most, 0.0, -1
    while True:
        full = F.col("weight") * level >= cap
        known = totals.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if known[2] == capped or not known[1]:
            break
        capped, level = known[2], (every - (known[0] or 0)) / known[1]
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * level)
    return totals.select("source", "source_size", "docs", target.alias("target"))


def _moments(size: Column, middle: float, spread: float) -> list[Column]:
    x = (F.log1p(size) - middle) / spread
    return [x, x * x - 1]


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small linear system, by elimination with pivots."""
    rows = [[*m, r] for m, r in zip(matrix, right, strict=True)]
    for k in range(len(rows)):
        top = max(range(k, len(rows)), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(len(rows)):
            if i != k:
                part = rows[i][k] / rows[k][k]
                rows[i] = [a - part * b for a, b in zip(rows[i], rows[k], strict=True)]
    return [row[-1] / row[k] for k, row in enumerate(rows)]


def balance(sized: DataFrame, sources: DataFrame, most: int = MAX_COPIES, penalty: float = PENALTY) -> tuple[DataFrame, Column]:
    """(sources with the multipliers ``lambda``, beta0 and beta1, the rate of a document as a column of these, size, source_size and target).

    A source whose target is its cap has the rate ``most`` throughout, one without words 0.
    """
    n, mean, square = sized.where("size > 0").agg(_total(F.col("size")), _total(F.col("size") * F.log1p("size")), _total(F.col("size") * F.log1p("size") * F.log1p("size"))).first()
    every = float(n or 1)
    middle = (mean or 0.0) / every
    spread = max(1e-6, math.sqrt(max(0.0, (square or 0.0) / every - middle * middle)))
    moments = _moments(F.col("size"), middle, spread)
    kinds = range(len(moments))
    full, none = F.col("target") >= most * F.col("source_size"), F.col("source_size") == 0
    open_ = ~full & ~none
    cells = stored(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "cells")

    # beta comes as columns: as literals it would have the expressions compiled again in every step.
    tilt = sum((F.col(f"beta{k}") * m for k, m in enumerate(moments)), F.col("lambda"))
    rate = F.when(none, 0.0).when(full, float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(tilt, F.lit(50.0)))))

    def told(now: DataFrame, beta: list[float]) -> DataFrame:
        """Of each source: residual, curvature, its products with the moments, and what it adds to their residuals and curvature."""
        now = now.withColumns({f"beta{k}": F.lit(b) for k, b in enumerate(beta)})
        at = now.select(F.col("source").alias("_of"), "source_size", "target", "lambda", *(f"beta{k}" for k in kinds))
        rows = cells.join(at, cells["source"].eqNullSafe(at["_of"]))
        taken = F.col("n") * F.col("size") * rate
        bends = F.when(open_ & (tilt < math.log(most)), taken).otherwise(0.0)
        sums = {"g": _total(taken), "d": _total(bends)}
        sums |= {f"m{k}": _total(taken * m) for k, m in enumerate(moments)} | {f"c{k}": _total(bends * m) for k, m in enumerate(moments)}
        sums |= {f"e{j}{k}": _total(bends * moments[j] * moments[k]) for j in range(len(moments)) for k in range(j + 1)}
        # The dual: of a rate r = exp(t) it has r, of one held at the cap what the line at the cap goes on to.
        held = F.when(open_, F.when(tilt < math.log(most), taken).otherwise(taken * (1 + tilt - math.log(most)))).otherwise(taken)
        sums["dual"] = _total(held + F.when(open_, 0.0).otherwise(taken * (tilt - F.col("lambda"))))
        of = rows.groupBy("_of").agg(*(v.alias(k) for k, v in sums.items()))
        joined = now.join(of, now["source"].eqNullSafe(of["_of"]), "left").drop("_of").fillna(0.0, list(sums))
        return stored(joined.withColumn("g", F.when(open_, F.col("g") - F.col("target")).otherwise(0.0)), "balance")

    now = sources.withColumn("lambda", F.when(open_ & (F.col("target") > 0), F.log(F.col("target") / F.col("source_size"))).when(open_, -50.0).otherwise(0.0))
    beta, best, trial, shrink = [0.0] * len(moments), None, told(now, [0.0] * len(moments)), 1.0
    keep = [*now.columns, *(f"beta{k}" for k in kinds)]
    for _ in range(STEPS):
        lean = F.col("d") > 0
        share = lambda x, y: F.when(lean, x * y / F.col("d")).otherwise(0.0)
        pairs = [(j, k) for j in kinds for k in range(j + 1)]
        # A handful of sums reach the driver.
        row = trial.agg(
            F.max(F.when(open_ & (F.col("target") > 0), F.abs(F.col("g")) / F.col("target"))),
            _total(F.col("dual") - F.when(open_, F.col("lambda") * F.col("target")).otherwise(0.0)),
            *(_total(F.col(f"m{k}")) for k in kinds),
            *(_total(share(F.col(f"c{k}"), F.col("g"))) for k in kinds),
            *(_total(F.col(f"e{j}{k}") - share(F.col(f"c{j}"), F.col(f"c{k}"))) for j, k in pairs),
        ).first()
        if row[1] is None:
            break
        value = row[1] + 0.5 * penalty * every * sum(b * b for b in beta)
        if best is not None and value > best[0] + 1e-9 * every and shrink > 1e-4:
            # Too far: half the step from where it began.
            shrink /= 2
        else:
            k0 = len(moments)
            slope = [row[2 + k] + penalty * every * beta[k] for k in kinds]
            if best is not None and (row[0] or 0.0) < RESIDUAL and max(abs(a - b) for a, b in zip(beta, best[1], strict=True)) < 1e-6:
                break
            table = [[0.0] * k0 for _ in kinds]
            for x, (j, k) in zip(row[2 + 2 * k0 :], pairs, strict=True):
                table[j][k] = table[k][j] = x + (penalty * every if j == k else 0.0)
            best, shrink = (value, beta, trial, _solve(table, [row[2 + k0 + k] - slope[k] for k in kinds])), 1.0
        _, start, here, move = best
        beta = [b + shrink * m for b, m in zip(start, move, strict=True)]
        follow = F.col("g") + sum((F.col(f"c{k}") * move[k] for k in kinds), F.lit(0.0))
        moved = F.col("lambda") - F.when(open_ & (F.col("d") > 0), shrink * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), follow / F.col("d")))).otherwise(0.0)
        trial = told(here.withColumn("lambda", moved).select(keep), beta)
    return stored(trial.select(keep), "balanced"), rate


def _with(rows: DataFrame, of: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """rows joined to the one row of ``of`` that agrees in ``by``, nulls too."""
    there = of.withColumnsRenamed({k: f"_of_{k}" for k in by})
    return rows.join(there, [rows[k].eqNullSafe(there[f"_of_{k}"]) for k in by]).drop(*(f"_of_{k}" for k in by))


def _cumulated(rows: DataFrame, x: str, name: str, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """rows (_part, _pos, source, ...) with the sum of x over this and earlier rows of the same ``by``.

    A window holds one partition's rows of a source; the sums of earlier
    partitions, one row for each, are added.
    """
    own = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *by).agg(F.sum(x).alias("_sum")).select("_part", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return _with(rows, parts, ("_part", *by)).withColumn(name, F.col("_before") + F.sum(x).over(own)).drop("_before")


#: A stratum, as SQL: rows of a source whose sizes differ by a fifth at most.
_STRATUM = "floor(4 * log2(size + 1))"
_FRACTION = "(rate - floor(rate))"
#: How soon a row is rounded up in its stratum: a fixed uniform number of its doc_id, less the part of its rate that is rounded.
_TURN = f"(shiftrightunsigned(xxhash64(doc_id), 11) / {1 << 53}D - {_FRACTION})"
#: Rows (rate, doc_id, cut) whose turn comes before their stratum's cut are rounded up.
_RULED = f"cast(floor(rate) + if({_FRACTION} > 0 AND {_TURN} < coalesce(cut, 2D), 1, 0) AS long)"


def round_rates(rated: DataFrame, repairs: int = REPAIRS) -> tuple[DataFrame, DataFrame]:
    """(rated (doc_id, source, size, rate, target, ...) with ``copies``, each the rate rounded down or up; cuts (source, stratum, cut)).

    In every stratum of a source the rows whose turn comes first are rounded up,
    as many as give the words that the rates ask of it. So a row's copies follow
    from itself and its stratum's cut. A source's words are then off its target
    by what the sizes differ; so in rounds rows that were rounded the wrong way
    for that, of no more words than are off, change over, from larger strata
    down while they fit. What stays is less than the least such row. These few,
    and rows of one turn of which only some fit, have other copies than the cuts give.
    """
    by, at = ("source", "stratum"), F.monotonically_increasing_id()
    parts = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("stratum").desc(), F.col("_turn"), F.col("doc_id")]
    fraction = F.expr(_FRACTION)
    turned = rated.withColumns({"stratum": F.expr(_STRATUM), "_turn": F.expr(_TURN), "_up": F.when(fraction > 0, F.greatest("size", F.lit(1))).otherwise(0).cast("long")})
    placed = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at)
    placed = stored(placed.withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), "placed")
    # The last row of a stratum goes up with the probability of what is left for it: a fixed uniform number of the stratum decides.
    luck = (F.pmod(F.xxhash64(*by), F.lit(1 << 20)) + 0.5) / (1 << 20)
    asked = placed.groupBy(*by).agg(_total(F.col("_up") * fraction).alias("_asked")).withColumn("_luck", luck)
    summed = _with(_cumulated(placed, "_up", "_upto", by), asked, by)
    up = (F.col("_up") > 0) & (F.col("_upto") - F.col("_up") * F.col("_luck") <= F.col("_asked"))
    rows = stored(summed.withColumn("copies", (F.floor("rate") + F.when(up, 1).otherwise(0)).cast("long")).drop("_upto", "_asked", "_luck"), "copied")
    cuts = stored(rows.groupBy(*by).agg(F.min(F.when((F.col("_up") > 0) & (F.col("copies") < F.col("rate")), F.col("_turn"))).alias("cut")), "cuts")
    for _ in range(repairs):
        off = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("_off"))
        wrong = F.when(F.col("_off") > 0, F.col("copies") < F.col("rate")).otherwise(F.col("copies") > F.col("rate"))
        movable = (F.col("size") > 0) & (F.col("size") <= F.abs("_off")) & wrong
        marked = _with(rows, off).withColumn("_fits", F.when(movable, F.col("size")).otherwise(0))
        marked = _cumulated(marked, "_fits", "_upto")
        turn = movable & (F.col("_upto") <= F.abs("_off"))
        changed = marked.withColumn("_changes", turn).withColumn("copies", F.col("copies") + F.when(turn, F.signum("_off").cast("long")).otherwise(0)).drop("_off", "_fits", "_upto")
        changed = stored(changed, "copied")
        done, rows = changed.where("_changes").isEmpty(), changed.drop("_changes")
        if done:
            break
    return rows.drop("_part", "_pos", "_turn", "_up"), cuts


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: int) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """(rows with copies, cuts, sources, the rate as a column of a row's size and its source's columns)."""
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sized")
    sources, rate = balance(sized, source_targets(sized, weights, most), most)
    rate = F.round(rate, 9)
    return *round_rates(_with(sized, sources).withColumn("rate", rate)), sources, rate


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row of docs (doc_id, text, source).

    Copies are the rate rounded up or down, so that a source's words come as
    near its target as its smallest rounded rows allow. They depend on doc_id,
    size and source alone. Null texts and texts without words have size 0 and
    take 0 words; a null source is a source; an empty table gives no rows.
    Repeated rows count as often as they come. Other columns are ignored.
    """
    return _mixed(docs, weights, most)[0].select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """docs with every row repeated as often as the mix copies it.

    A row's copies follow from its own rate and turn and its stratum's cut, but
    for the few rows that the mix rounds otherwise, so texts stay where they are.
    Rows that share a doc_id, or have none, are told apart by source and size;
    those that agree in all three have the same copies only if their places do,
    so they get the largest of theirs. A text without words has the copies of
    its rate. Null sources, empty tables and columns of any name are fine.
    """
    rows, cuts, sources, rate = _mixed(docs, weights, most)
    # Stored, the sizes of both are known: a row for each stratum of a source, and the rows that are rounded otherwise.
    rules = stored(_with(cuts, sources), "rules")
    key = ("doc_id", "source", "size")
    ruled = _with(rows.select(*key, "stratum", "rate", "copies"), cuts, ("source", "stratum")).withColumn("_ruled", F.expr(_RULED))
    others = stored(ruled.groupBy(*key).agg(F.max("copies").alias("other"), F.max(F.col("copies") != F.col("_ruled")).alias("_odd")).where("_odd").drop("_odd"), "others")
    # The document as one column, so that its names are its own.
    sized = docs.select(F.struct(*docs.columns).alias("_doc")).select("_doc", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"), words(F.col("_doc.text")).alias("size"))
    told = _with(sized.withColumn("stratum", F.expr(_STRATUM)), rules, ("source", "stratum")).withColumn("rate", rate).select("_doc", *key, F.expr(_RULED).alias("_ruled"))
    others = others.withColumnsRenamed({k: f"_of_{k}" for k in key})
    told = told.join(others, [told[k].eqNullSafe(others[f"_of_{k}"]) for k in key], "left").select("_doc", F.coalesce("other", "_ruled").alias("_copies"))
    return told.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


#: The columns of op3_mixing that SQL can express.
OP3_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(turn % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap, 3 * source_size / CAST(turn % 3 + 1 AS DOUBLE) AS ratio FROM totals),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / sum(weight) OVER (ORDER BY ratio, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
first AS (SELECT ratio AS r1, turn AS t1, level AS l1 FROM levels WHERE level < ratio ORDER BY ratio, turn LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN r1 IS NULL OR (ratio, turn) < (r1, t1) THEN CAST(cap AS DOUBLE) ELSE weight * l1 END AS target FROM levels LEFT JOIN first ON true)
SELECT doc_id, size, source_size, target, sized.source AS source FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""
