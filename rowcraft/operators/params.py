"""Positional ``$n`` parameters of SQL text, bound by name and never inlined."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = re.compile(r"\$(\d+)(?!\w)")


@dataclass(frozen=True)
class Parameter:
    """A value with the Spark type it is bound as."""

    value: Any
    type: str

    def bound(self) -> Column:
        return F.lit(self.value).cast(self.type)


def bind(text: str, values: Sequence[Any]) -> tuple[str, dict[str, Any]]:
    """Text with named parameters, and their values.

    ``$1`` is not the beginning of ``$10``; a parameter may be used again.
    """
    used = {int(m) for m in _PLACE.findall(text)}
    if used and max(used) >= len(values):
        raise ValueError(f"${max(used)} has no value; {len(values)} are given")
    named = _PLACE.sub(lambda m: f":p{int(m[1])}", text)
    args = {f"p{k}": v.bound() if isinstance(v, Parameter) else F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v for k, v in enumerate(values) if k in used}
    return named, args


def query(spark: SparkSession, text: str, values: Sequence[Any] = (), tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """SQL text over the catalog, and over DataFrames written as ``{name}``."""
    named, args = bind(text, values)
    return spark.sql(named, args, **(tables or {})) if tables else spark.sql(named, args)
