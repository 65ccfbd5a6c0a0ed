"""Named factories, rules over rows, and parsed tables that are kept: what callers extend the engine with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import hierarchy, sheets


class Registry:
    """Factories by name."""

    def __init__(self, what: str):
        self.what, self._factories = what, {}

    def register(self, name: str, factory: Callable) -> None:
        self._factories[name] = factory

    def create(self, name: str, *args, **options):
        if name not in self._factories:
            raise KeyError(f"unknown {self.what}: {name}")
        return self._factories[name](*args, **options)

    def names(self) -> list[str]:
        return sorted(self._factories)


PROVIDERS, PARSERS, BUILDERS = Registry("provider"), Registry("parser"), Registry("builder")
PROVIDERS.register("echo", lambda **_: lambda prompt: prompt)
PARSERS.register("records", lambda: sheets.records)
PARSERS.register("hybrid", lambda: lambda rows: sheets.hybrid(rows)[0])
PARSERS.register("details", lambda: sheets.detail_records)
BUILDERS.register("hierarchy", lambda orphans="root": lambda rows: hierarchy.built(rows, orphans))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds violations: names of the rules that a row does not meet; a rule that is null is not met."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def transformed(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Sets columns by rules (column, condition, value), one after another."""
    for column, condition, value in rules:
        rows = rows.withColumn(column, F.when(condition, value).otherwise(F.col(column)))
    return rows


class CachedParser:
    """A parser whose results are kept by key until they are given up; tables are parsed by partitions, all at once or as a stream."""

    def __init__(self, parse: Callable[[DataFrame], DataFrame]):
        self.parse, self.kept = parse, {}

    def __call__(self, key: str, rows: DataFrame) -> DataFrame:
        if key not in self.kept:
            self.kept[key] = self.parse(rows).cache()
        return self.kept[key]

    def give_up(self, key: str | None = None) -> None:
        for k in [key] if key is not None else list(self.kept):
            if k in self.kept:
                self.kept.pop(k).unpersist()
