"""Views that the market queries share, in SQL that Spark and other engines read alike.

``bars``: one row a symbol (supplier) and day, from lineitem. ``market``: the mean
close a day with its return and a volatility index. ``trades``: lineitem with its
order as closed trades. Places for tables are written {lineitem}.
"""

KEY = "(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)"
VIEWS = {
    "bars": f"""bars AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, min_by(px, {KEY}) AS open, max(px) AS high, min(px) AS low,
  max_by(px, {KEY}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM {{lineitem}}) t GROUP BY l_suppkey, l_shipdate)""",
    "rets": """rets AS (SELECT symbol, ts, close, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)""",
    "market": """daily AS (SELECT ts, round(avg(close), 4) AS px, count(*) AS n FROM bars GROUP BY ts),
market0 AS (SELECT ts, px, n, px / lag(px) OVER (ORDER BY ts) - 1 AS ret FROM daily),
market AS (SELECT ts, px, n, round(ret, 8) AS ret, round(1500 * avg(abs(ret)) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 3) / 12 AS vix FROM market0 WHERE ret IS NOT NULL)""",
    "sectors": """sectors AS (SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)""",
    "trades": """trades AS (SELECT l_orderkey AS trade_id, l_suppkey AS symbol, o_orderpriority AS strategy, o_orderdate AS entry_ts, l_shipdate AS exit_ts,
  CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, CASE l_returnflag WHEN 'A' THEN 'target' WHEN 'N' THEN 'time' ELSE 'stop' END AS exit_reason,
  l_quantity AS qty, l_extendedprice / l_quantity AS price, round(l_extendedprice * (l_tax - l_discount), 2) + 0.0 AS pnl,
  round(100 * (l_tax - l_discount), 2) + 0.0 AS pnl_pct, round(500 * abs(l_discount), 1) AS slippage_bps FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)""",
    "ticks": """ticks AS (SELECT event_type AS symbol, ts, CAST(ts AS DATE) AS day, value AS price, 1 + event_id % 7 AS size, event_id FROM {events})""",
}
NEEDS = {"rets": ("bars",), "market": ("bars",)}


def rounded(sql: str) -> str:
    """``round(x, k)`` written as floor(x * 1ek + 0.5) / 1ek: engines break ties of round() apart, of floor() not."""
    while (at := sql.rfind("round(")) >= 0:
        depth, comma, end = 1, -1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        k = sql[comma + 1 : end - 1].strip()
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * 1e{k} + 5e-1) / 1e{k}){sql[end:]}"
    return sql


def with_views(body: str, *names: str) -> str:
    """A query over the named views and what they need."""
    wanted: list[str] = []
    for name in names:
        wanted += [x for x in (*NEEDS.get(name, ()), name) if x not in wanted]
    return "WITH " + ",\n".join(VIEWS[x] for x in wanted) + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+")


def over(n: int | None = None, by: str = "symbol", at: str = "ts") -> str:
    """A window of the last n rows of a symbol, or of all so far."""
    frame = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    part = f"PARTITION BY {by} " if by else ""
    return f"OVER ({part}ORDER BY {at} ROWS BETWEEN {frame} AND CURRENT ROW)"


def rolled(agg: str, x: str, n: int, by: str = "symbol") -> str:
    """An aggregate over the last n rows, null until n values are there."""
    return f"CASE WHEN count({x}) {over(n, by)} = {n} THEN {agg}({x}) {over(n, by)} END"


def lagged(x: str, k: int = 1, by: str = "symbol") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"lag({x}, {k}) OVER ({part}ORDER BY ts)"
