"""Entity maps generated from what is there: tables, files, declared keys.

Spark tables carry no constraints, so keys and foreign keys come from a side
table of declarations. The result is Python source of ``EntityMap`` values.
"""

from __future__ import annotations

import argparse
import keyword
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from rowcraft.operators.entity import EntityMap, Field

MARK = "# Generated from the catalog; changes are lost."

#: Native type names and the Spark type each is read as.
NATIVE_TYPES = {
    "tinyint unsigned": "short", "tinyint": "byte", "smallint": "short", "int2": "short", "smallint unsigned": "int", "int": "int", "integer": "int",
    "int4": "int", "mediumint": "int", "int unsigned": "bigint", "bigint": "bigint", "int8": "bigint", "bigint unsigned": "decimal(20,0)", "real": "float",
    "float4": "float", "float": "double", "float8": "double", "double precision": "double", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "boolean": "boolean", "bool": "boolean", "bit": "boolean", "date": "date", "time": "string", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz",
    "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
    "datetimeoffset": "timestamp", "uuid": "string", "uniqueidentifier": "string", "char": "string", "varchar": "string", "nvarchar": "string",
    "character varying": "string", "text": "string", "json": "string", "jsonb": "string", "xml": "string", "bytea": "binary", "blob": "binary",
    "varbinary": "binary", "image": "binary", "rowversion": "bigint",
}


def native_type(name: str, precision: int | None = None, scale: int | None = None) -> tuple[str, str | None]:
    """The Spark type of a native type, and a warning if it is a guess."""
    known = name.strip().lower()
    if known.endswith("[]"):
        inner, warning = native_type(known[:-2])
        return f"array<{inner}>", warning
    if known == "tinyint(1)":
        return "boolean", "tinyint(1) is taken for a Boolean"
    if known in ("numeric", "decimal", "number"):
        p, s = precision or 38, scale or 0
        return ("int" if p < 10 else "bigint" if p <= 18 else f"decimal({p},0)") if s == 0 else f"decimal({p},{s})", None
    found = NATIVE_TYPES.get(known) or NATIVE_TYPES.get(known.split("(")[0].strip())
    return (found, None) if found else ("string", f"{name} is not known and read as text")


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    target: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class Declared:
    """What Parquet can't say about a table."""

    key: tuple[str, ...] = ()
    identity: str | None = None
    row_version: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    declared: Declared = field(default_factory=Declared)
    view: bool = False

    @property
    def read_only(self) -> bool:
        """A view, or a table that nothing identifies a row of."""
        return self.view or not self.declared.key


def from_directory(spark: SparkSession, path: str, names: Sequence[str], declared: Mapping[str, Declared] | None = None) -> list[Table]:
    """Parquet tables ``name.parquet`` below a directory."""
    known = declared or {}
    return [Table(n, spark.read.parquet(f"{path}/{n}.parquet").schema, known.get(n, Declared())) for n in sorted(names)]


def from_catalog(spark: SparkSession, database: str | None = None, ignored: Sequence[str] = (), declared: Mapping[str, Declared] | None = None) -> list[Table]:
    """Tables and views of a database of the catalog."""
    known, out = declared or {}, []
    for t in spark.catalog.listTables(database):
        if not matches(t.name, ignored):
            full = f"{database}.{t.name}" if database and not t.isTemporary else t.name
            out.append(Table(t.name, spark.table(full).schema, known.get(t.name, Declared()), t.tableType in ("VIEW", "TEMPORARY")))
    return sorted(out, key=lambda t: t.name)


def matches(name: str, patterns: Sequence[str]) -> bool:
    """Case-insensitive; a pattern may end with ``*``."""
    return any(name.lower().startswith(p[:-1].lower()) if p.endswith("*") else name.lower() == p.lower() for p in patterns)


# names


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + (p[1:].lower() if p.isupper() else p[1:]) for p in re.split(r"[\W_]+", name) if p)


#: Nouns whose plural follows no rule.
IRREGULAR = {"people": "person", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "geese": "goose", "feet": "foot", "teeth": "tooth", "oxen": "ox"}
#: Nouns that are their own plural.
UNCHANGING = frozenset("series species news sheep fish deer data equipment information".split())
_LAST_WORD = re.compile(r"[A-Z]?[a-z]+$|[A-Z]+$")


def _ends(word: str) -> tuple[str, str]:
    """What stands before the last word of a name, and that word."""
    found = _LAST_WORD.search(word)
    return (word[: found.start()], found[0]) if found else (word, "")


def _cased(made: str, like: str) -> str:
    return made.upper() if like.isupper() and len(like) > 1 else made.capitalize() if like[:1].isupper() else made


def singular(word: str, irregular: Mapping[str, str] | None = None) -> str:
    """The singular of a name's last word; ``irregular`` adds plurals to the known ones."""
    before, last = _ends(word)
    low, known = last.lower(), IRREGULAR | dict(irregular or {})
    if low in known:
        return before + _cased(known[low], last)
    if low in UNCHANGING or low in known.values() or low.endswith(("ss", "us", "is")):
        return word
    if low.endswith("uses") and not low.endswith(("ouses", "auses")):
        return word[:-2]
    for end, put in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("s", "")):
        if low.endswith(end) and len(low) > len(end) + 1:
            return word[: -len(end)] + put
    return word


def plural(word: str, irregular: Mapping[str, str] | None = None) -> str:
    """The plural of a name's last word."""
    before, last = _ends(word)
    low, known = last.lower(), {one: many for many, one in (IRREGULAR | dict(irregular or {})).items()}
    if low in known:
        return before + _cased(known[low], last)
    if low in UNCHANGING or low in known.values():
        return word
    if low.endswith("y") and low[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if low.endswith(("s", "x", "z", "ch", "sh")) else "s")


def uncertain(word: str, irregular: Mapping[str, str] | None = None) -> bool:
    """Whether a name does not come back from singular and plural."""
    return word not in (plural(singular(word, irregular), irregular), singular(plural(word, irregular), irregular))


def safe(name: str) -> str:
    """A Python identifier."""
    made = re.sub(r"\W", "_", name)
    made = f"_{made}" if made[:1].isdigit() else made
    return f"{made}_" if keyword.iskeyword(made) else made


# relations


@dataclass(frozen=True)
class Relation:
    """``many`` rows of a table for one of another, by their columns."""

    name: str
    owner: str
    columns: tuple[str, ...]
    other: str
    other_columns: tuple[str, ...]
    many: bool


def relations(tables: Sequence[Table], irregular: Mapping[str, str] | None = None) -> tuple[list[Relation], list[str]]:
    """Relations from foreign keys both ways, and what was left out or is a guess."""
    by_name, found, warnings = {t.name: t for t in tables}, [], []
    for t in tables:
        if uncertain(t.name, irregular):
            warnings.append(f"{t.name}: singular and plural of the name are a guess")
        for fk in t.declared.foreign:
            if fk.table not in by_name:
                warnings.append(f"{t.name}: {fk.table} is not there")
                continue
            target = fk.target or by_name[fk.table].declared.key
            if len(target) != len(fk.columns):
                warnings.append(f"{t.name}: the key of {fk.table} has other columns")
                continue
            twice = sum(o.table == fk.table for o in t.declared.foreign) > 1
            role = re.sub(r"_?(id|key)$", "", fk.columns[0], flags=re.IGNORECASE)
            one = pascal(role if twice else singular(fk.table, irregular))
            many = pascal(plural(singular(t.name, irregular), irregular)) + (f"By{pascal(role)}" if twice else "")
            unique = fk.columns == t.declared.key or fk.columns in t.declared.unique
            found.append(Relation(one, t.name, fk.columns, fk.table, target, False))
            found.append(Relation(pascal(singular(t.name, irregular)) if unique else many, fk.table, target, t.name, fk.columns, not unique))
    taken: set[tuple[str, str]] = {(t.name, pascal(c).lower()) for t in tables for c in t.schema.names}
    out = []
    for r in found:
        name = r.name
        while (r.owner, name.lower()) in taken:
            name += "Ref" if not r.many else "List"
        taken.add((r.owner, name.lower()))
        out.append(Relation(name, r.owner, r.columns, r.other, r.other_columns, r.many))
    return out, warnings


# emitting


def entity_map(table: Table, naming: str = "pascal") -> EntityMap:
    d = table.declared
    made = []
    for f in table.schema:
        name = safe(pascal(f.name) if naming == "pascal" else f.name)
        made.append(Field(name, f.dataType.simpleString(), None if name == f.name else f.name, f.nullable, key=f.name in d.key, identity=f.name == d.identity, row_version=f.name == d.row_version))
    return EntityMap(table.name, tuple(made), read_only=table.read_only)


def emit(tables: Sequence[Table], naming: str = "pascal", irregular: Mapping[str, str] | None = None) -> str:
    """Source of a module with one map a table, and the relations."""
    lines = [MARK, "from rowcraft.operators.entity import EntityMap, Field", "from rowcraft.sources.scaffold import Relation", ""]
    for t in tables:
        m = entity_map(t, naming)
        lines.append(f"{safe(singular(t.name, irregular)).upper()} = EntityMap({t.name!r}, (")
        for f in m.fields:
            extra = [f"column={f.column!r}"] if f.column else []
            extra += [f"{n}=True" for n in ("key", "identity", "row_version") if getattr(f, n)] + ([] if f.nullable else ["nullable=False"])
            lines.append(f"    Field({', '.join([repr(f.name), repr(f.type), *extra])}),")
        lines += [f"){', read_only=True' if m.read_only else ''})", ""]
    found, warnings = relations(tables, irregular)
    lines += ["RELATIONS = (", *[f"    {r!r}," for r in found], ")", *[f"# {w}" for w in warnings]]
    return "\n".join(lines) + "\n"


def write(path: str, text: str, force: bool = False, dry_run: bool = False) -> str:
    """Writes a generated file; says "unchanged", "written" or what it would do.

    A file without the generated mark is someone's work and stays.
    """
    target = Path(path)
    if target.exists():
        old = target.read_text()
        if old == text:
            return "unchanged"
        if not old.startswith(MARK) and not force:
            return "kept"
    if dry_run:
        return "would write"
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return "written"


def options(arguments: Sequence[str], environment: Mapping[str, str] | None = None, file: Mapping[str, str] | None = None) -> argparse.Namespace:
    """Settings: a file's, over them the environment's, over them arguments."""
    known, env = dict(file or {}), os.environ if environment is None else environment
    parser = argparse.ArgumentParser(prog="python -m rowcraft.sources.scaffold")
    for name, default in (("path", "."), ("tables", ""), ("out", "entities.py"), ("naming", "pascal"), ("ignore", "")):
        parser.add_argument(f"--{name}", default=env.get(f"ROWCRAFT_{name.upper()}", known.get(name, default)))
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--force", action="store_true")
    return parser.parse_args(arguments)


def main(arguments: Sequence[str] | None = None) -> None:
    import sys

    chosen = options(sys.argv[1:] if arguments is None else arguments)
    names = [n for n in chosen.tables.split(",") if n and not matches(n, chosen.ignore.split(","))]
    tables = from_directory(SparkSession.builder.getOrCreate(), chosen.path, names)
    print(write(chosen.out, emit(tables, chosen.naming), chosen.force, chosen.dry_run))


if __name__ == "__main__":
    main()
