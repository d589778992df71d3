"""Filter objects on column names, combined with AND.

Unlike predicates they bind their value as it is: ``eq(column, None)`` compares
with null and so matches nothing; ``is_null`` asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.predicate import _escape_for
from rowcraft.operators.entity import quoted


@dataclass(frozen=True)
class Filter:
    column: str
    test: str
    value: Any = None

    @property
    def condition(self) -> Column:
        return _TESTS[self.test](F.col(quoted(self.column)), self.value)


def _like(c: Column, pattern: str) -> Column:
    return F.like(c, F.lit(pattern), F.lit(_escape_for(pattern)))


def _ilike(c: Column, pattern: str) -> Column:
    return F.ilike(c, F.lit(pattern), F.lit(_escape_for(pattern)))


_TESTS = {
    "eq": lambda c, v: c == F.lit(v),
    "neq": lambda c, v: c != F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "ngt": lambda c, v: c <= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "nlt": lambda c, v: c >= F.lit(v),
    "is_null": lambda c, _: c.isNull(),
    "not_null": lambda c, _: c.isNotNull(),
    "like": _like,
    "not_like": lambda c, v: ~_like(c, v),
    "ilike": _ilike,
    "not_ilike": lambda c, v: ~_ilike(c, v),
    "match": lambda c, v: c.rlike(v),
    "not_match": lambda c, v: ~c.rlike(v),
    "imatch": lambda c, v: c.rlike(f"(?i){v}"),
    "not_imatch": lambda c, v: ~c.rlike(f"(?i){v}"),
}


def _factory(test: str, with_value: bool = True):
    def make(column: str, value: Any = None) -> Filter:
        return Filter(column, test, value)

    def make_bare(column: str) -> Filter:
        return Filter(column, test)

    return make if with_value else make_bare


eq, neq, gt, gte, ngt, lt, lte, nlt = (_factory(t) for t in ("eq", "neq", "gt", "gte", "ngt", "lt", "lte", "nlt"))
is_null, not_null = _factory("is_null", False), _factory("not_null", False)
like, not_like, ilike, not_ilike = (_factory(t) for t in ("like", "not_like", "ilike", "not_ilike"))
match, not_match, imatch, not_imatch = (_factory(t) for t in ("match", "not_match", "imatch", "not_imatch"))


def all_of(*filters: Filter) -> Column:
    """All filters at once; none at all is an error."""
    if not filters:
        raise ValueError("at least one filter is needed")
    return reduce(and_, (f.condition for f in filters))


def apply(df: DataFrame, *filters: Filter) -> DataFrame:
    return df.filter(all_of(*filters))
