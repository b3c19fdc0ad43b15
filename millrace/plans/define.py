"""How a plan module registers its queries: a DataFrame built from Tables, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.sources.canonical import Tables, oracle


def cents_sql(x: str, places: int = 2) -> str:
    """The SQL twin of millrace.functions.money.cents."""
    return f"cast(round(cast({x} as decimal(28, 8)), {places}) as double)"


def exact_sum(x: str, where: str) -> str:
    """A cent-exact sum over the rows that meet a condition, 0 without such rows."""
    return f"cast(coalesce(sum(cast({x} as decimal(18, 2))) filter ({where}), 0) as double)"


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            self.oracles[name] = oracle(sql)
