"""Where queries register, each with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def split_by_id(key: str = "doc_id") -> Column:
    """The driver tables have no split; one in 20 ids decides."""
    k = F.pmod(F.col(key), F.lit(20))
    return F.when(k < 14, "train").when(k < 17, "val").otherwise("test")


#: The same in SQL.
SPLIT = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END"
#: Rounding of reports; operators return unrounded values.
DIGITS = 6


def rounded(*names: str, digits: int = DIGITS) -> dict[str, Column]:
    return {n: F.round(n, digits) for n in names}


def rounded_doubles(*names: str, digits: int = DIGITS) -> dict[str, Column]:
    """``rounded`` for doubles, as SQL engines round them: the scaled double, half away from zero, with its sign. A small negative number becomes -0.0, where Spark's decimal rounding drops the sign."""
    scale = float(10**digits)
    return {n: F.signum(n) * (F.round(F.abs(n) * scale, 0) / scale) for n in names}
