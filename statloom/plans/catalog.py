"""Registry of named queries: a Spark builder plus (optionally) its SQL oracle.

``register(key, sql=..., sig_cols=[...])`` wraps a ``(spark, sf_dir) ->
DataFrame`` builder.  Columns listed in ``sig_cols`` are rounded to 9
significant digits on both sides (Spark via ``sig``, SQL via ``* REPLACE``),
so engines that sum in a different order still hash equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from statloom.functions.exprs import sig_columns, sig_sql


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    sig_cols: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        present = [c for c in self.sig_cols if c in df.columns]  # data-dependent outputs
        if present:
            df = sig_columns(df, present)
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.sig_cols:
            return self.sql
        rep = ", ".join(f"{sig_sql(c)} AS {c}" for c in self.sig_cols)
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) AS _q"


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None, sig_cols: list[str] | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, list(sig_cols or []))
        return fn
    return deco


def union_sql(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)
