"""Registry of queries over the given tables, and the inputs derived from them.

A derived input is one SQL text that Spark and the oracle both run; `{name}` stands
for another table or derived input.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import fit_tasks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INPUTS: dict[str, str] = {}


class Source:
    """The tables of one directory and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # The tables' timestamps carry no zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._bytes = 0
        fit_tasks(spark, 0)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._bytes += int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
                fit_tasks(self.spark, self._bytes)
                self._made[name] = table
            else:
                needs = {n: getattr(self, n) for n in _needs(INPUTS[name])}
                self._made[name] = self.spark.sql(INPUTS[name], **needs)
        return self._made[name]

    def over(self, **tables: DataFrame) -> Source:
        """The same inputs, derived anew over other rows of the given tables."""
        out = copy.copy(self)
        out._made = {**{n: t for n, t in self._made.items() if n in TABLES}, **tables}
        return out


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def oracle(sql: str) -> str:
    """`sql` with every `{input}` it uses defined in front, in order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in TABLES and name not in ordered:
                visit(INPUTS.get(name) or ORACLE_PARTS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    parts = [f"{n} AS ({_plain(INPUTS.get(n) or ORACLE_PARTS[n])})" for n in ordered]
    return (f"WITH {', '.join(parts)} " if parts else "") + _plain(sql)


def _plain(sql: str) -> str:
    return re.sub(r"\{([a-z]\w*)\}", r"\1", sql)


ORACLE_PARTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan `f(source)`, with the SQL that must give the same rows."""

    def add(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
