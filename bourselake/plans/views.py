"""SQL text of the derived tables, prepended to each SQL twin as CTEs."""
from __future__ import annotations

# The derived tables in SQL.
VIEWS = {
    "bars": ((), """
WITH raw AS (
  SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS date,
         SUM(l.l_quantity) AS volume, COUNT(*) AS trades, AVG(l.l_discount) AS d, AVG(l.l_tax) AS t,
         AVG(CAST(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END AS DOUBLE)) AS n
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
path AS (
  SELECT *, 100 * EXP(SUM((d - 0.05) * 0.6 + 0.0004) OVER (PARTITION BY symbol ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS c FROM raw),
o AS (
  SELECT *, COALESCE(LAG(c) OVER (PARTITION BY symbol ORDER BY date), CAST(100 AS DOUBLE))
            * (1 + (t - 0.04) * 0.25) AS op FROM path)
SELECT symbol, date, R4(op) AS open, R4(GREATEST(op, c) * (1 + t * 0.1)) AS high,
       R4(LEAST(op, c) * (1 - t * 0.1)) AS low, R4(c) AS close, volume, trades,
       FLOOR(1000000 * n + 0.50001) / 10000 AS delivery_pct
FROM o"""),
    "constituents": ((), """
SELECT DISTINCT r.r_name AS sector, p.p_brand AS symbol
FROM part p JOIN region r
  ON CAST(REGEXP_REPLACE(p.p_brand, '[^0-9]+', '') AS INT) % 5 = r.r_regionkey"""),
    "bench_index": (("bars",), """
SELECT date, FLOOR(1000000 * EXP(SUM(m) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
       AND CURRENT ROW)) + 0.50001) / 10000 AS close
FROM (SELECT date, AVG(LN(close / pc)) AS m FROM (
        SELECT date, close, LAG(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars) a
      WHERE pc IS NOT NULL GROUP BY date) b"""),
    "flows": ((), """
SELECT CAST(o_orderdate AS DATE) AS date,
       CASE WHEN SUBSTRING(o_orderpriority, 1, 1) IN ('1', '2') THEN 'FII' ELSE 'DII' END AS category,
       R2(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END)) AS buy_value,
       R2(SUM(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END)) AS sell_value
FROM orders GROUP BY 1, 2"""),
    "signals": ((), """
SELECT event_id AS signal_ref, event_type AS skill,
       CONCAT('Brand#', CAST(user_id % 25 + 1 AS VARCHAR)) AS ticker,
       CASE WHEN value >= 50 THEN 'LONG' WHEN value >= 10 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction,
       R4(LEAST(value / 200, CAST(1 AS DOUBLE))) AS raw_score,
       DATE '1998-01-01' + CAST(event_id % 1000 AS INT) AS signal_date, ts
FROM events"""),
    "rates": ((), """
SELECT CAST(o_orderdate AS DATE) AS date,
       2 + 3 * AVG(CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE)) AS year2,
       2 + 3 * AVG(CAST(CASE WHEN SUBSTRING(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 1 ELSE 0 END AS DOUBLE)) AS year10
FROM orders GROUP BY 1"""),
    "news": ((), """
SELECT doc_id AS news_id, SPLIT_PART(text, chr(10), 1) AS title, text AS body, source, lang,
       CONCAT('Brand#', CAST(doc_id % 25 + 1 AS VARCHAR)) AS symbol,
       DATE '1998-01-01' + CAST(doc_id % 1000 AS INT) AS published
FROM documents"""),
    "financials_wide": ((), """
SELECT p.p_brand AS symbol, l.l_returnflag AS line_item,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 1995 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y1995,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 1996 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y1996,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 1997 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y1997,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 1998 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y1998,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 1999 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y1999,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 2000 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y2000,
       SUM(CASE WHEN YEAR(l.l_shipdate) = 2001 THEN l.l_quantity ELSE CAST(0 AS DOUBLE) END) AS y2001
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2"""),
}


def add_view(name: str, needs: str, sql: str) -> None:
    """Name an intermediate table so that several SQL twins can share it."""
    VIEWS[name] = (tuple(needs.split()), sql)


def _expand(sql: str) -> str:
    """Spell out the rounding shorthands R2(..), R4(..), R6(..) and the clip C01(..)."""
    heads = {"R2(": ("FLOOR((", ") * 100 + 0.50001) / 100"),
             "R4(": ("FLOOR((", ") * 10000 + 0.50001) / 10000"),
             "R6(": ("FLOOR((", ") * 1000000 + 0.50001) / 1000000"),
             "C01(": ("LEAST(GREATEST((", "), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))")}
    for head, (left, right) in heads.items():
        while (at := sql.find(head)) >= 0:
            depth, end = 1, at + len(head)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + left + sql[at + len(head):end - 1] + right + sql[end:]
    return sql


def with_views(views, sql: str) -> str:
    """Prepend the CTEs the statement needs, dependencies first."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dependency in VIEWS[name][0]:
            need(dependency)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    sql = sql.strip()
    head = "WITH "
    if sql.startswith("WITH RECURSIVE"):
        head, sql = "WITH RECURSIVE ", sql.removeprefix("WITH RECURSIVE").lstrip()
        rest = ", " + sql if ordered else sql
    elif sql.startswith("WITH"):
        sql = sql.removeprefix("WITH").lstrip()
        rest = ", " + sql if ordered else sql
    else:
        rest = "\n" + sql
        if not ordered:
            return _expand(sql)
    if any(f"FROM {v} " in VIEWS[v][1] for v in ordered):
        head = "WITH RECURSIVE "
    ctes = ", ".join(
        f"{v} AS {'' if f'FROM {v} ' in VIEWS[v][1] else 'MATERIALIZED '}({VIEWS[v][1].strip()})"
        for v in ordered)
    return _expand(head + ctes + rest)


# -- window text ---------------------------------------------------------------------------
BY = "PARTITION BY symbol ORDER BY date"


def tr(n: int, by: str = BY) -> str:
    return f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def run(by: str = BY) -> str:
    return f"({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def agg(fn: str, x: str, n: int, least: int | None = None, by: str = BY) -> str:
    w = tr(n, by)
    return f"(CASE WHEN COUNT({x}) OVER {w} >= {least or n} THEN {fn}({x}) OVER {w} END)"


def avg(x: str, n: int, least: int | None = None, by: str = BY) -> str:
    return agg("AVG", x, n, least, by)


def std(x: str, n: int, least: int | None = None, by: str = BY) -> str:
    return agg("STDDEV_SAMP", x, n, least, by)


def lag(x: str, n: int = 1, by: str = BY) -> str:
    return f"LAG({x}, {n}) OVER ({by})"


def ewm_view(name: str, source: str, x: str, alpha: float, keys: str = "symbol",
             order: str = "date") -> None:
    """A recursive CTE (keys, rn, order, y) of the exponential mean of `x` in view `source`."""
    same = " AND ".join(f"s.{k} = e.{k}" for k in keys.split(", "))
    cols = ", ".join(f"s.{k}" for k in keys.split(", "))
    add_view(f"{name}_in", source,
             f"SELECT {keys}, {order}, CAST({x} AS DOUBLE) AS x, ROW_NUMBER() OVER "
             f"(PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source} WHERE {x} IS NOT NULL")
    add_view(name, f"{name}_in",
             f"SELECT {keys}, rn, {order}, x AS y FROM {name}_in WHERE rn = 1 UNION ALL "
             f"SELECT {cols}, s.rn, s.{order}, CAST({alpha!r} AS DOUBLE) * s.x + "
             f"CAST({1.0 - alpha!r} AS DOUBLE) * e.y "
             f"FROM {name} e JOIN {name}_in s ON {same} AND s.rn = e.rn + 1")
