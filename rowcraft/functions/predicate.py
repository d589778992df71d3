"""Predicates in Python that become native Spark expressions.

``entity(map)`` gives an object whose attributes are the mapped fields. They
compose with operators and methods into a Spark ``Column``; no text is built
and no user function is involved, so filters reach the Parquet scan.

Python evaluates everything that is not a field before it gets here, so clocks
and variables are the caller's, not the cluster's.

Three-valued logic is Spark's, but for what convenience would break: comparing
with ``None`` tests for null, an empty list matches nothing (its negation
everything), and nulls in a list are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.operators.entity import EntityMap, MappingError, quoted


class UnsupportedExpression(TypeError):
    """Something that has no native translation. There is no fallback."""


def _escape_for(pattern: str) -> str:
    """An escape character that a raw LIKE pattern does not contain."""
    return next(c for c in "!~^|\x01\x02\x03\x04" if c not in pattern)


class Term:
    """A Spark column and the family of its type."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, column: Column, kind: str, field: Any = None):
        self.column, self.kind, self.field = column, kind, field

    def __bool__(self) -> bool:
        raise UnsupportedExpression("a predicate has no truth value here; combine with &, | and ~, not with and, or and not")

    def __iter__(self):
        raise UnsupportedExpression("a term can't be iterated; use .in_(values)")

    # comparison

    def _compare(self, other: Any, compare: Callable[[Column, Column], Column]) -> Term:
        return Term(compare(self.column, _column(other)), "bool")

    def __eq__(self, other: Any) -> Term:  # type: ignore[override]
        return self.is_null() if other is None else self._compare(other, lambda a, b: a == b)

    def __ne__(self, other: Any) -> Term:  # type: ignore[override]
        return self.is_not_null() if other is None else self._compare(other, lambda a, b: a != b)

    def __lt__(self, other: Any) -> Term:
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other: Any) -> Term:
        return self._compare(other, lambda a, b: a <= b)

    def __gt__(self, other: Any) -> Term:
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other: Any) -> Term:
        return self._compare(other, lambda a, b: a >= b)

    def is_null(self) -> Term:
        return Term(self.column.isNull(), "bool")

    def is_not_null(self) -> Term:
        return Term(self.column.isNotNull(), "bool")

    has_value = is_not_null

    @property
    def value(self) -> Term:
        return self

    # logic and bits

    def _both(self, other: Any, logic: str) -> Term:
        bits = self.kind == "int" and _kind(other) == "int"
        if bits:
            a, b = self.column, _column(other)
            return Term(a.bitwiseAND(b) if logic == "and" else a.bitwiseOR(b), "int")
        a, b = condition(self), condition(other)
        return Term(a & b if logic == "and" else a | b, "bool")

    def __and__(self, other: Any) -> Term:
        return self._both(other, "and")

    def __or__(self, other: Any) -> Term:
        return self._both(other, "or")

    __rand__, __ror__ = __and__, __or__

    def __invert__(self) -> Term:
        return Term(~condition(self), "bool")

    # arithmetic

    def _arithmetic(self, other: Any, sign: str, swap: bool = False) -> Term:
        whole = self.kind == "int" and _kind(other) == "int"
        a, b = self.column, _column(other)
        a, b = (b, a) if swap else (a, b)
        if sign == "/" and whole:  # division of integers truncates
            return Term(F.call_function("div", a, b), "int")
        made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[sign]()
        return Term(made, "int" if whole else "number")

    def __add__(self, other: Any) -> Term:
        if self.kind == "text":
            return self.concat(other)
        return self._arithmetic(other, "+")

    def __radd__(self, other: Any) -> Term:
        if self.kind == "text":
            return Term(F.concat(_column(other), self.column), "text")
        return self._arithmetic(other, "+", True)

    def __sub__(self, other: Any) -> Term:
        return self._arithmetic(other, "-")

    def __rsub__(self, other: Any) -> Term:
        return self._arithmetic(other, "-", True)

    def __mul__(self, other: Any) -> Term:
        return self._arithmetic(other, "*")

    __rmul__ = __mul__

    def __truediv__(self, other: Any) -> Term:
        return self._arithmetic(other, "/")

    def __rtruediv__(self, other: Any) -> Term:
        return self._arithmetic(other, "/", True)

    def __mod__(self, other: Any) -> Term:
        return self._arithmetic(other, "%")

    def __rmod__(self, other: Any) -> Term:
        return self._arithmetic(other, "%", True)

    def __neg__(self) -> Term:
        return Term(-self.column, self.kind)

    # choice

    def coalesce(self, *others: Any) -> Term:
        return Term(F.coalesce(self.column, *map(_column, others)), self.kind)

    def then(self, yes: Any, no: Any) -> Term:
        """``yes`` where this holds, else ``no``; a null condition is ``no``."""
        return Term(F.when(condition(self), _column(yes)).otherwise(_column(no)), _kind(yes))

    # text

    def upper(self) -> Term:
        return Term(F.upper(self.column), "text")

    def lower(self) -> Term:
        return Term(F.lower(self.column), "text")

    def trim(self) -> Term:
        return Term(F.trim(self.column), "text")

    def replace(self, old: Any, new: Any) -> Term:
        return Term(F.replace(self.column, _column(old), _column(new)), "text")

    def substring(self, start: Any, length: Any = None) -> Term:
        """From a zero-based start, to the end or so many characters."""
        first = _column(start) + 1
        return Term(F.substr(self.column, first) if length is None else F.substr(self.column, first, _column(length)), "text")

    def index_of(self, part: Any) -> Term:
        """Zero-based place of a part; -1 if it is not there."""
        return Term(F.locate(part, self.column) - 1 if isinstance(part, str) else F.position(_column(part), self.column) - 1, "int")

    @property
    def length(self) -> Term:
        return Term(F.length(self.column), "int")

    def is_null_or_empty(self) -> Term:
        return Term(self.column.isNull() | (F.coalesce(self.column, F.lit("")) == ""), "bool")

    def equals(self, other: Any, ignore_case: bool = False) -> Term:
        if other is None:
            return self.is_null()
        return self._compare(other, lambda a, b: F.upper(a) == F.upper(b)) if ignore_case else self == other

    def concat(self, *others: Any) -> Term:
        """Null if any part is null."""
        return Term(F.concat(self.column, *map(_column, others)), "text")

    def _part(self, part: Any, ignore_case: bool, before: str, after: str, literal: Callable[[Column, Any], Column]) -> Term:
        a = F.upper(self.column) if ignore_case else self.column
        if isinstance(part, Term):  # a column's wildcards stay active
            b = F.upper(part.column) if ignore_case else part.column
            return Term(F.like(a, F.concat(F.lit(before), b, F.lit(after)), F.lit("\x01")), "bool")
        if not isinstance(part, str):
            raise UnsupportedExpression("a text part must be a string or a field")
        return Term(literal(a, F.upper(F.lit(part)) if ignore_case else part), "bool")

    def starts_with(self, part: Any, ignore_case: bool = False) -> Term:
        return self._part(part, _flag(ignore_case), "", "%", lambda a, b: a.startswith(b))

    def ends_with(self, part: Any, ignore_case: bool = False) -> Term:
        return self._part(part, _flag(ignore_case), "%", "", lambda a, b: a.endswith(b))

    def contains(self, part: Any, ignore_case: bool = False) -> Term:
        return self._part(part, _flag(ignore_case), "%", "%", lambda a, b: a.contains(b))

    def like(self, pattern: str) -> Term:
        """A raw pattern: % and _ are wildcards and nothing escapes them."""
        return Term(F.like(self.column, F.lit(pattern), F.lit(_escape_for(pattern))), "bool")

    def ilike(self, pattern: str) -> Term:
        return Term(F.ilike(self.column, F.lit(pattern), F.lit(_escape_for(pattern))), "bool")

    def matches(self, pattern: str, ignore_case: bool = False) -> Term:
        """Whether a regular expression is found anywhere in the text."""
        return Term(self.column.rlike(f"(?i){pattern}" if _flag(ignore_case) else pattern), "bool")

    # date and time

    def _date_part(self, part: Callable[[Column], Column]) -> Term:
        return Term(part(self.column), "int")

    year = property(lambda self: self._date_part(F.year))
    month = property(lambda self: self._date_part(F.month))
    day = property(lambda self: self._date_part(F.dayofmonth))
    hour = property(lambda self: self._date_part(F.hour))
    minute = property(lambda self: self._date_part(F.minute))
    second = property(lambda self: self._date_part(F.second))
    date = property(lambda self: Term(self.column.cast("date"), "date"))

    # mathematics

    def __abs__(self) -> Term:
        return Term(F.abs(self.column), self.kind)

    def floor(self) -> Term:
        return Term(F.floor(self.column), "int")

    def ceiling(self) -> Term:
        return Term(F.ceil(self.column), "int")

    def round(self, digits: int = 0, scale: int | None = None) -> Term:
        """Half away from zero. To ``digits`` places a double is rounded as a
        decimal of ``scale`` places, so that 1.005 is not 1.00499."""
        if digits == 0:
            return Term(F.round(self.column), self.kind)
        return Term(F.round(self.column.cast(f"decimal(38,{scale or digits + 6})"), digits), "number")

    # membership

    def in_(self, values: Iterable[Any] | DataFrame) -> Term:
        """Membership in a list, without its nulls; none if it is empty.

        A DataFrame of one column is a subquery: a semi join, and negated the
        null-aware anti join of NOT IN.
        """
        if isinstance(values, DataFrame):
            return Term(self.column.isin(values), "bool")
        kept = list(dict.fromkeys(v for v in values if v is not None))
        if not kept:
            return Term(F.lit(False), "bool")
        return self == kept[0] if len(kept) == 1 else Term(self.column.isin(kept), "bool")

    def in_list(self, values: Iterable[Any]) -> Term:
        """As ``in_``, but an empty list is an error."""
        kept = [v for v in values if v is not None]
        if not kept:
            raise ValueError("the list has no values")
        return self.in_(kept)

    def in_query(self, of: EntityMap, df: DataFrame, where: Callable[[Entity], Term], select: Callable[[Entity], Term] | None = None) -> Term:
        """Membership in a field of the rows of another entity.

        Without ``select`` it is the field of the same property name, else of
        the same column name. The condition sees the inner entity only.
        """
        inner = Entity(of)
        if select is not None:
            chosen = select(inner)
            if chosen.field is None:
                raise UnsupportedExpression("a subquery selects a mapped field, not an expression")
        else:
            if self.field is None:
                raise UnsupportedExpression("only a mapped field can name the field of a subquery")
            chosen = next((inner._term(n) for n in (self.field.name, self.field.source) if _mapped(of, n)), None)
            if chosen is None:
                raise MappingError(f"{of.table} has no field like {self.field.name}")
        try:
            rows = df.filter(condition(where(inner)))
        except AnalysisException as unresolved:
            raise UnsupportedExpression("a subquery sees its own entity only; correlated subqueries are not supported") from unresolved
        return self.in_(rows.select(chosen.column))


def _mapped(of: EntityMap, name: str) -> bool:
    try:
        return bool(of[name])
    except MappingError:
        return False


def _flag(value: Any) -> bool:
    if not isinstance(value, bool):
        raise UnsupportedExpression("ignore_case is either True or False")
    return value


def _kind(value: Any) -> str:
    if isinstance(value, Term):
        return value.kind
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "number", str: "text"}.get(type(value), type(value).__name__)


def _column(value: Any) -> Column:
    if isinstance(value, Term):
        return value.column
    if isinstance(value, Column):
        return value
    if callable(value) or isinstance(value, (list, dict, set)):
        raise UnsupportedExpression(f"{value!r} can't be part of an expression")
    return F.lit(value)


def condition(value: Any) -> Column:
    """A term, constant or column as a filter condition.

    An integer stands for a stored Boolean: it holds where it is 1.
    """
    if isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, Term):
        if value.kind in ("int", "number"):
            return value.column == 1
        if value.kind not in ("bool", "boolean"):
            raise UnsupportedExpression(f"a {value.kind} is not a condition")
        return value.column
    if isinstance(value, Column):
        return value
    raise UnsupportedExpression(f"{value!r} is not a condition")


class Entity:
    """The fields of a map as terms, optionally of an aliased DataFrame."""

    def __init__(self, of: EntityMap, alias: str | None = None):
        self._map, self._alias = of, alias

    def _term(self, name: str) -> Term:
        found = self._map[name]
        if found.expression:
            return Term(F.expr(found.expression), found.kind, found)
        prefix = f"{quoted(self._alias)}." if self._alias else ""
        return Term(F.col(prefix + quoted(found.source)), found.kind, found)

    def __getattr__(self, name: str) -> Term:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self._term(name)
        except MappingError as missing:
            raise UnsupportedExpression(str(missing)) from missing

    __getitem__ = _term


def where(df: DataFrame, of: EntityMap, predicate: Callable[[Entity], Any]) -> DataFrame:
    """The rows of a table for which a predicate holds."""
    return df.filter(condition(predicate(Entity(of))))


def join_where(left: DataFrame, left_map: EntityMap, right: DataFrame, right_map: EntityMap, predicate: Callable[[Entity, Entity], Any], how: str = "inner") -> DataFrame:
    """A join on a predicate over two entities, aliased ``a`` and ``b``."""
    return left.alias("a").join(right.alias("b"), condition(predicate(Entity(left_map, "a"), Entity(right_map, "b"))), how)
