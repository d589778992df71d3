"""Named sources and procedures.

A source is a format, a path or table, and options; ``%NAME%`` in any of them
is replaced by an environment variable and ``%NAME[start,length]%`` by a part
of it. A procedure is a function from a session and arguments to a DataFrame.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_VARIABLE = re.compile(r"%(\w+)(?:\[(\d+)(?:,(\d+))?\])?%")


def substitute(text: str, environment: Mapping[str, str] | None = None) -> str:
    """Fills in environment variables; an unknown one stays as it is."""
    known = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        found = known.get(m[1])
        if found is None:
            return m[0]
        start = int(m[2] or 0)
        return found[start : start + int(m[3])] if m[3] else found[start:]

    return _VARIABLE.sub(value, text)


@dataclass(frozen=True)
class Source:
    format: str
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        """A DataFrame of the source; ``table`` reads from the catalog."""
        reader = spark.read
        for name, value in self.options.items():
            reader = reader.option(name, substitute(str(value)))
        path = substitute(self.path) if self.path else None
        if self.format == "table":
            return spark.table(path)
        return reader.format(self.format).load(path) if path else reader.format(self.format).load()


def jdbc(url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> Source:
    """A database table, read in parallel where a numeric column is given."""
    made = {"url": url, "dbtable": table, **options}
    if partition_column and bounds:
        made |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return Source("jdbc", None, made)


class Registry:
    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}
        self._procedures: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, source: Source) -> None:
        self._sources[name.lower()] = source

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        try:
            return self._sources[name.lower()].read(spark)
        except KeyError:
            raise LookupError(f"no source is called {name}") from None

    def procedure(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Decorator that registers a procedure."""

        def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._procedures[name.lower()] = function
            return function

        return register

    def call(self, spark: SparkSession, name: str, *args: Any) -> DataFrame:
        try:
            return self._procedures[name.lower()](spark, *args)
        except KeyError:
            raise LookupError(f"no procedure is called {name}") from None


def run_script(spark: SparkSession, text: str, separator: str = r"^\s*GO\s*$") -> list[DataFrame]:
    """Runs SQL statements that stand between separator lines."""
    parts = re.split(separator, text, flags=re.MULTILINE | re.IGNORECASE)
    return [spark.sql(part) for part in parts if part.strip()]
