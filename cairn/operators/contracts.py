"""Data contracts: each is a DataFrame of the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractBroken(ValueError):
    pass


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition is false; unknown is no violation."""
    return df.filter(~F.expr(condition))


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("__p")), F.col(column) == F.col("__p"), "left_anti")


def not_dense(df: DataFrame, column: str) -> DataFrame:
    """One row if a column isn't 1..N; none for an empty table."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.countDistinct(column).alias("d")).filter("n > 0 AND (low <> 1 OR high <> n OR d <> n)")


def unaligned(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two lists differ in length."""
    return df.filter(~F.coalesce(F.size(a), F.lit(-1)).eqNullSafe(F.coalesce(F.size(b), F.lit(-1))))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def require(checks: dict[str, DataFrame]) -> None:
    bad = {r["rule"]: r["violations"] for r in summary(checks).collect() if r["violations"]}
    if bad:
        raise ContractBroken(bad)
