"""Dates let through by a gate: each allowed date rules out those that follow too soon.

Whether a date is allowed depends on the allowed date before it. But the next
allowed date depends on a date alone: every date gets a pointer to it, and the
dates that a key's first one leads to come by one walk over its sorted pointers.
A key's dates are one row; keys are spread over the tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_DAY = "_day"


def _later(keys: list[str], gap: int) -> WindowSpec:
    """From a key's last row back to ``gap`` days after the current one: a frame that grows from its beginning costs a row each, the other way round all rows each."""
    return Window.partitionBy(*keys).orderBy(F.desc(_DAY)).rangeBetween(Window.unboundedPreceding, -gap)


def _with_day(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn(_DAY, F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")))


def after_gap(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """rows (one for each key and date) with ``next_at``: the key's first date at least ``gap`` days later."""
    return _with_day(rows, at).withColumn("next_at", F.min(at).over(_later(keys, gap))).drop(_DAY)


def after_change(rows: DataFrame, keys: list[str], at: str, state: str, gap: int) -> DataFrame:
    """rows with ``next_at``: the key's first date at least ``gap`` days later on which the state is another one.

    That is the first date after the gap, or, if the state is the same there, the start of the next run of a state.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    runs = _with_day(rows, at).withColumn("_starts", ~F.col(state).eqNullSafe(F.lag(state).over(w)))
    back = Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_turn", F.min(F.when(F.col("_starts"), F.col(at))).over(back))
    found = runs.withColumn("_first", F.min(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), F.col(state).alias("state"), F.col("_turn").alias("turn")))).over(_later(keys, gap)))
    return found.withColumn("next_at", F.when(F.col("_first.state").eqNullSafe(F.col(state)), F.col("_first.turn")).otherwise(F.col("_first.at"))).select(*rows.columns, "next_at")


def chained(pointers: DataFrame, keys: list[str], at: str, gap: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """The (keys, at, carried columns) that each key's first date leads to by next_at, itself included.

    Pointers lead on by ``gap`` days at least, never back. Null keys and dates are left out.
    """
    known = pointers.where(" and ".join(f"`{c}` is not null" for c in (*keys, at)))
    row = F.struct(*(F.col(c) for c in (at, *carried)))
    steps = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col("next_at").alias("next"), row.alias("row"))))

    def step(so_far, s):  # noqa: ANN001, ANN202
        return F.when(s["at"] == so_far["next"], F.struct(s["next"].alias("next"), F.concat(so_far["rows"], F.array(s["row"])).alias("rows"))).otherwise(so_far)

    first = F.element_at("_steps", 1)
    walk = F.aggregate(F.slice("_steps", F.lit(2), F.size("_steps")), F.struct(first["next"].alias("next"), F.array(first["row"]).alias("rows")), step, lambda x: x["rows"])
    walks = known.groupBy(*keys).agg(steps.alias("_steps")).select(*keys, F.explode(walk).alias("_row"))
    return walks.select(*keys, *(F.col("_row").getField(c).alias(c) for c in (at, *carried)))
