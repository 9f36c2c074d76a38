"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

# A shift far from any simple fraction, in units of the last kept digit: values that lie exactly
# half way between two rounded results are then not decided by the order in which numbers add up.
SHIFT = 0.0371234


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql.strip()
        return fn

    return wrap


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; NaN stays, and the result is never minus zero."""
    if isinstance(column, str):
        return F.expr(_rounded(column, digits))
    unit = F.lit(float(10**digits))
    return F.rint(column * unit + F.lit(SHIFT)) / unit + F.lit(0.0)


def _rounded(name: str, digits: int) -> str:
    unit = f"{float(10**digits)!r}D"
    return f"rint(`{name}` * {unit} + {SHIFT!r}D) / {unit} + 0.0D"


def rn(*names: str) -> list[Column]:
    return [F.expr(f"{_rounded(n, 6)} AS `{n}`") for n in names]


def s(expr: str, digits: int = 6) -> str:
    unit = f"CAST({10**digits} AS DOUBLE)"
    return f"(round(({expr}) * {unit} + {SHIFT!r}) / {unit} + 0.0)"


def sn(*names: str, prefix: str = "") -> str:
    return ", ".join(f'{s(prefix + chr(34) + n + chr(34))} AS "{n}"' for n in names)


KEYS = "date_id, time_id, symbol_id"

# The dense panel P.
PANEL = """
WITH base AS (
  SELECT CAST((year(l_shipdate)-1995)*12 + month(l_shipdate)-1 AS SMALLINT) AS date_id,
         CAST(l_suppkey % 5 AS SMALLINT) AS symbol_id,
         l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
         (l_extendedprice - 52500.0)/52500.0 AS sig_a, (l_quantity - 25.5)/25.5 AS sig_b
  FROM lineitem),
seq AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY date_id, symbol_id
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS time_id
  FROM base),
P AS (
  SELECT date_id, time_id, symbol_id, l_quantity AS weight,
    l_extendedprice/1000.0 AS feature_00,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS feature_01,
    CASE WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS feature_02,
    sig_a AS feature_03,
    avg(sig_a) OVER w20  - avg(sig_b) OVER w20  AS responder_0,
    avg(sig_a) OVER w120 - avg(sig_b) OVER w120 AS responder_1,
    avg(sig_a) OVER w4   - avg(sig_b) OVER w4   AS responder_2,
    avg(sig_a) OVER w20 AS responder_3, avg(sig_a) OVER w120 AS responder_4, avg(sig_a) OVER w4 AS responder_5,
    avg(sig_b) OVER w20 AS responder_6, avg(sig_b) OVER w120 AS responder_7, avg(sig_b) OVER w4 AS responder_8
  FROM seq
  WINDOW w4   AS (PARTITION BY date_id, symbol_id ORDER BY time_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING),
         w20  AS (PARTITION BY date_id, symbol_id ORDER BY time_id ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING),
         w120 AS (PARTITION BY date_id, symbol_id ORDER BY time_id ROWS BETWEEN CURRENT ROW AND 119 FOLLOWING))"""

# The gapped panel S.
SLOTS = """
WITH S AS (
  SELECT CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS SMALLINT) AS date_id,
         CAST(hour(ts) AS SMALLINT) AS time_id, CAST(user_id % 5 AS SMALLINT) AS symbol_id,
         CAST(count(*) AS DOUBLE) AS weight, avg(value) AS feature_00, max(value) AS feature_01
  FROM events GROUP BY 1, 2, 3)"""

# Predictions on P.
PREDICTED = PANEL + """,
Q AS (SELECT *, """ + ", ".join(f"0.6*responder_{i} + 0.1*feature_03 AS pred_{i}" for i in range(9)) + """ FROM P)"""

# P with responders rounded to 9 digits.
SETTLED = PANEL + """,
R AS (SELECT * REPLACE (""" + ", ".join(f"round(responder_{i}, 9) AS responder_{i}" for i in range(9)) + """) FROM P)"""

# Logits and step blocks.
LOGITS = """
WITH L AS (
  SELECT vec_id, CAST(label % 4 AS INT) AS cls,
    [8.0::DOUBLE*embedding[1]::DOUBLE, 8.0::DOUBLE*embedding[2]::DOUBLE,
     8.0::DOUBLE*embedding[3]::DOUBLE, 8.0::DOUBLE*embedding[4]::DOUBLE] AS logits,
    embedding[5:9]::DOUBLE[] AS steps_a, embedding[10:14]::DOUBLE[] AS steps_b,
    embedding[15:35]::DOUBLE[] AS block21, embedding[36]::DOUBLE AS y, CAST(1.0 + label AS DOUBLE) AS w
  FROM embeddings)"""


def clean(column: str) -> str:
    """SQL for NaN to null."""
    return f"CASE WHEN isnan({column}) THEN NULL ELSE {column} END"


def zero(column: str) -> str:
    """SQL for NaN and null to zero."""
    return f"CASE WHEN {column} IS NULL OR isnan({column}) THEN 0.0 ELSE {column} END"
