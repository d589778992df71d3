"""Reading entities: scans, filters, pages, counts, first rows.

An adapter binds a map to a table. Every method that returns a DataFrame is
lazy; those that return rows or numbers run one Spark job. A filter is given as
a predicate (``lambda e: e.Price > 5``), as filter objects, as SQL text with
``$n`` parameters, or not at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowcraft.functions.predicate import Entity, condition
from rowcraft.operators import filters, params
from rowcraft.operators.entity import EntityMap, quoted

Hook = Callable[[DataFrame], None]

_QUOTED_OR_COMMA = re.compile(r"'(?:[^'\\\\]|\\\\.)*'|\"[^\"]*\"|`[^`]*`|[(),]")
_DIRECTION = re.compile(r"^(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?$", re.IGNORECASE | re.DOTALL)


def _parts(text: str) -> list[str]:
    """Cuts an ORDER BY text at the commas outside brackets and quotes."""
    out, depth, start = [], 0, 0
    for m in _QUOTED_OR_COMMA.finditer(text):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "," and depth == 0:
            out.append(text[start : m.start()])
            start = m.end()
    return [p.strip() for p in [*out, text[start:]]]


def _ordered(text: str) -> Column:
    """One part of an ORDER BY text as a sort column."""
    name, way, nulls = _DIRECTION.match(text).groups()
    c, down = F.expr(name), (way or "").lower() == "desc"
    made = {"": (c.asc, c.desc), "first": (c.asc_nulls_first, c.desc_nulls_first), "last": (c.asc_nulls_last, c.desc_nulls_last)}
    return made[(nulls or "").lower()][down]()


class Adapter:
    """``table`` is a DataFrame, or the name of a table in the catalog."""

    def __init__(self, spark: SparkSession, of: EntityMap, table: DataFrame | str | None = None, order_by: str | list | None = None, no_lock: bool = False):
        self.spark, self.map, self.order_by = spark, of, order_by
        self._table = of.table if table is None else table
        self.no_lock = no_lock  # every read sees one snapshot; accepted and without effect
        self.before_read: list[Hook] = []

    def on_table(self, table: DataFrame | str) -> Adapter:
        other = Adapter(self.spark, self.map, table, self.order_by, self.no_lock)
        other.before_read = self.before_read
        return other

    @property
    def table(self) -> DataFrame:
        return self._table if isinstance(self._table, DataFrame) else self.spark.table(self._table)

    # rows that match, unprojected, so that a filter may use any column

    def matching(self, *asked: Any, args: Iterable[Any] = ()) -> DataFrame:
        df = self.table
        if not asked:
            return df
        first = asked[0]
        if isinstance(first, filters.Filter):
            return filters.apply(df, *asked)
        if isinstance(first, str):
            return self._by_text(df, first, list(args or asked[1:]))
        if isinstance(first, Column):
            return df.filter(first)
        if callable(first):
            return df.filter(condition(first(Entity(self.map))))
        raise TypeError(f"{first!r} is not a filter")

    @staticmethod
    def _by_text(df: DataFrame, text: str, values: list) -> DataFrame:
        if not text.strip():
            return df
        return params.query(df.sparkSession, f"SELECT * FROM {{source}} WHERE {text}", values, {"source": df})

    def _ordering(self) -> list[Column]:
        given = self.order_by if isinstance(self.order_by, list) else [self.order_by] if self.order_by else []
        return [c for g in given for c in ([g] if isinstance(g, Column) else map(_ordered, _parts(g)))]

    def _ready(self, df: DataFrame) -> DataFrame:
        for hook in self.before_read:
            hook(df)
        return df

    # DataFrames

    def fill(self, *asked: Any, args: Iterable[Any] = ()) -> DataFrame:
        """Mapped columns of the matching rows, in the adapter's order."""
        df = self.matching(*asked, args=args)
        if ordering := self._ordering():
            df = df.orderBy(*ordering)
        return self._ready(self.map.project(df))

    def fill_all(self) -> DataFrame:
        return self.fill()

    def fill_range(self, start: int, length: int, *asked: Any, args: Iterable[Any] = ()) -> DataFrame:
        """A page; without an order it would not be one, so that is an error."""
        if not self.order_by:
            raise ValueError("a page needs order_by")
        return self._ready(self.map.project(self.matching(*asked, args=args).orderBy(*self._ordering()).offset(start).limit(length)))

    def fill_with(self, df: DataFrame) -> DataFrame:
        """Mapped columns of a DataFrame from elsewhere."""
        return self._ready(self.map.project(df))

    def fill_rows(self, rows: Iterable[Any]) -> DataFrame:
        """Mapped columns of rows that a caller holds."""
        return self.fill_with(self.spark.createDataFrame(list(rows), self.map.struct()))

    # counts

    def count_of(self, *asked: Any, args: Iterable[Any] = ()) -> DataFrame:
        """One row with the number of matches as ``count``."""
        if asked and asked[0] is None:
            raise ValueError("the filter is null")
        return self.matching(*asked, args=args).agg(F.count(F.lit(1)).alias("count"))

    def get_count(self, *asked: Any, args: Iterable[Any] = ()) -> int:
        return self.count_of(*asked, args=args).first()[0]

    def exists_of(self, *asked: Any, args: Iterable[Any] = ()) -> DataFrame:
        """One row that says as ``exists`` whether there is a match."""
        return self.matching(*asked, args=args).limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))

    def exists(self, *asked: Any, args: Iterable[Any] = ()) -> bool:
        return not self.matching(*asked, args=args).limit(1).isEmpty()

    # rows

    def first_of(self, *asked: Any, args: Iterable[Any] = ()) -> DataFrame:
        df = self.matching(*asked, args=args)
        if ordering := self._ordering():
            df = df.orderBy(*ordering)
        return self.map.project(df.limit(1))

    def get_one(self, *asked: Any, args: Iterable[Any] = ()) -> Row | None:
        return next(iter(self.first_of(*asked, args=args).collect()), None)

    def get_list(self, *asked: Any, args: Iterable[Any] = ()) -> list[Row]:
        return self.fill(*asked, args=args).collect()

    def get_array(self, *asked: Any, args: Iterable[Any] = ()) -> tuple[Row, ...]:
        return tuple(self.get_list(*asked, args=args))

    def open_reader(self, *asked: Any, args: Iterable[Any] = (), make: Callable[[Row], Any] | None = None) -> Iterator[Any]:
        """Rows one by one; one partition at a time is on the driver.

        ``make`` turns a row into what the caller wants.
        """
        return read_rows(self.fill(*asked, args=args), make)


def read_rows(df: DataFrame, make: Callable[[Row], Any] | None = None) -> Iterator[Any]:
    rows = df.toLocalIterator(prefetchPartitions=True)
    return map(make, rows) if make else rows


def read_values(df: DataFrame) -> Iterator[tuple]:
    return map(tuple, df.toLocalIterator(prefetchPartitions=True))


def select_runtime(df: DataFrame, columns: list[str], *asked: filters.Filter | str | Column) -> DataFrame:
    """A scan whose columns are named at run time.

    The filter comes first, so it may use columns that are not selected.
    """
    for test in asked:
        df = df.filter(test.condition if isinstance(test, filters.Filter) else test)
    return df.select(*[F.col(quoted(c)) for c in columns])


def sorted_by(df: DataFrame, *names: str) -> DataFrame:
    """Ordered by properties; ``-name`` descends. Nulls are first, or last if descending."""
    return df.orderBy(*[F.desc_nulls_last(quoted(n[1:])) if n.startswith("-") else F.asc_nulls_first(quoted(n)) for n in names])
