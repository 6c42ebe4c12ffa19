"""Query catalogue: registration helpers shared by the query modules.

Each query takes ``(spark, sf_dir)``, derives the mail tables from the
driver tables and runs one operator of the library over the whole tables.
Floats are rounded to 6 places in both the Spark result and the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracles as O
from ..functions import columns as C
from ..operators import decisions as D
from ..sources import bridge as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's count_if is BIGINT.  Cast
    every count_if(...) call so both engines report the same type."""
    out, i = [], 0
    token = "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, m = 1, j + len(token)
        while depth and m < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[m], 0)
            m += 1
        out.append(sql[i:j])
        out.append(f"CAST({sql[j:m]} AS BIGINT)")
        i = m


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = _bigint_count_if(sql)
        return fn

    return deco


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def doc_score(message_id: Column) -> Column:
    """The fixed integer-arithmetic scorer keyed by the numeric id."""
    return B.fixed_score(F.substring(message_id, 2, 1 << 30).cast("bigint"))


SQL_DOC_SCORE = "CAST(CAST(substr({m}, 2) AS BIGINT) * 37 % 101 AS DOUBLE) / 100"
SQL_SENDER_DOMAIN = "CASE WHEN contains({a}, '@') THEN lower(string_split({a}, '@')[-1]) ELSE 'unknown' END"

