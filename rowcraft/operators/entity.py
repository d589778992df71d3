"""Entity maps: which columns of a table an application sees, and how.

A map is declared once and never changes. It names the table, and for each
field its property, column, Spark type, keys, access and length. ``project``
turns any DataFrame into the mapped shape; everything stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A field longer than this takes no part in concurrency checks by default.
MOST_COMPARED_LENGTH = 32768


class MappingError(ValueError):
    """A map contradicts itself or lacks what was asked of it."""


def quoted(name: str) -> str:
    """A column name in back ticks, so that spaces and reserved words work."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Field:
    """One mapped column.

    ``access`` is "rw", "r" or "w"; write-only fields are never selected.
    ``since`` is the schema version that introduced the field. ``expression``
    makes it a computed, read-only field.
    """

    name: str
    type: str
    column: str | None = None
    nullable: bool = True
    length: int | None = None
    trim_to_fit: bool = False
    key: bool = False
    partition: bool = False
    identity: bool = False
    row_version: bool = False
    access: str = "rw"
    since: int = 0
    default: object = None
    compared: bool | None = None
    expression: str | None = None

    @property
    def source(self) -> str:
        return self.column or self.name

    @property
    def readable(self) -> bool:
        return "r" in self.access

    @property
    def writable(self) -> bool:
        return "w" in self.access and self.expression is None and not self.row_version

    @property
    def comparable(self) -> bool:
        """Whether an update may check this field's original value."""
        if self.compared is not None:
            return self.compared
        return self.type not in ("binary", "variant") and (self.length or 0) <= MOST_COMPARED_LENGTH

    @cached_property
    def data_type(self) -> T.DataType:
        return T._parse_datatype_string(self.type)

    @property
    def kind(self) -> str:
        """Family of the type, as far as predicates care."""
        base = self.type.split("(")[0]
        if base in ("byte", "tinyint", "short", "smallint", "int", "integer", "long", "bigint"):
            return "int"
        if base in ("float", "double", "decimal"):
            return "number"
        return {"boolean": "bool", "string": "text"}.get(base, base)


@dataclass(frozen=True)
class EntityMap:
    """Fields of one table. ``save_to`` names the table that writes go to."""

    table: str
    fields: tuple[Field, ...]
    save_to: str | None = None
    read_only: bool = False
    criteria: str = "changed"
    _by_name: dict = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        known: dict[str, Field] = {}
        columns = set()
        for f in self.fields:
            if f.name.lower() in known:
                raise MappingError(f"property {f.name} is mapped twice")
            if f.source.lower() in columns:
                raise MappingError(f"column {f.source} is mapped twice")
            known[f.name.lower()] = f
            columns.add(f.source.lower())
        object.__setattr__(self, "_by_name", known)

    @classmethod
    def implicit(cls, table: str, schema: T.StructType, keys: tuple[str, ...] = (), **options) -> EntityMap:
        """Every column as a field of the same name."""
        lowered = {k.lower() for k in keys}
        if missing := lowered - {f.name.lower() for f in schema}:
            raise MappingError(f"key {', '.join(sorted(missing))} is not a column of {table}")
        fields = (Field(f.name, f.dataType.simpleString(), nullable=f.nullable, key=f.name.lower() in lowered) for f in schema)
        return cls(table, tuple(fields), **options)

    def at_version(self, version: int) -> EntityMap:
        """The map without fields that are newer; version 0 is the latest."""
        return self if version == 0 else replace(self, fields=tuple(f for f in self.fields if f.since <= version))

    def on_table(self, table: str) -> EntityMap:
        return replace(self, table=table)

    def __getitem__(self, name: str) -> Field:
        """A field by property name, else by column name; case is ignored."""
        found = self._by_name.get(name.lower()) or next((f for f in self.fields if f.source.lower() == name.lower()), None)
        if found is None:
            raise MappingError(f"{name} is not mapped on {self.table}")
        return found

    @property
    def readable(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.readable)

    @property
    def keys(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.key)

    @property
    def all_keys(self) -> tuple[Field, ...]:
        """Primary and partition keys."""
        return tuple(f for f in self.fields if f.key or f.partition)

    @property
    def target(self) -> str:
        return self.save_to or self.table

    def selection(self, present: list[str], qualifier: str | None = None) -> list[Column]:
        """Readable fields in map order, under their property names.

        A column that is not there gives the field's default.
        """
        have, out = {c.lower() for c in present}, []
        prefix = f"{quoted(qualifier)}." if qualifier else ""
        for f in self.readable:
            if f.expression:
                value = F.expr(f.expression)
            elif f.source.lower() in have:
                value = F.col(prefix + quoted(f.source))
            else:
                value = F.lit(f.default).cast(f.data_type)
            out.append(value.alias(f.name))
        return out

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*self.selection(df.columns))

    def struct(self) -> T.StructType:
        """The Spark schema of the stored columns."""
        return T.StructType([T.StructField(f.source, f.data_type, f.nullable) for f in self.fields if not f.expression])
