"""Delimited and fixed-width text files as DataFrames, both ways.

A record is an ordered list of fields. Parsing stays in Spark's readers and
built-in functions; only the strict mode, whose quoting rules no built-in reader
has, splits lines in Arrow batches. Correct quoting is the default on writing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowcraft.functions.arrow import map_arrow
from rowcraft.operators.entity import quoted

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: What a Boolean field may begin with to be true.
_TRUE = ("T", "t", "Y", "y", "1")


@dataclass(frozen=True)
class TextField:
    """One field. ``position`` counts from 0; left out, it follows the last.

    ``offset`` and ``length`` place it in fixed-width lines; a missing length
    reaches to the next field. In delimited text ``length`` cuts the value.
    """

    name: str
    type: str = "string"
    position: int | None = None
    offset: int | None = None
    length: int | None = None
    default: object = None
    trim: bool = True
    true_values: str | None = None
    format: str | None = None


@dataclass(frozen=True)
class TextRecord:
    fields: tuple[TextField, ...]
    delimiter: str = ","
    qualifier: str = '"'
    header: bool = False
    short_lines: str = "accept"  # or "skip", or "raise"

    def positions(self) -> list[int]:
        out, at = [], 0
        for f in self.fields:
            at = at if f.position is None else f.position
            out.append(at)
            at += 1
        if len(set(out)) < len(out):
            raise ValueError("two fields have one position")
        return out

    def spans(self) -> list[tuple[int, int | None]]:
        """Offset and length of each field of a fixed-width line."""
        out, at = [], 0
        for k, f in enumerate(self.fields):
            start = at if f.offset is None else f.offset
            following = self.fields[k + 1].offset if k + 1 < len(self.fields) else None
            length = f.length or (following - start if following is not None else None)
            out.append((start, length))
            at = start + (length or 0)
        return out


def _typed(f: TextField, raw: Column) -> Column:
    """A field's value from its text; an empty one is the default."""
    text = F.trim(raw) if f.trim else raw
    if f.length:
        text = F.substring(text, 1, f.length)
    base = f.type.split("(")[0]
    if f.type == "boolean":
        made = F.instr(F.lit(f.true_values), text) > 0 if f.true_values else F.substring(text, 1, 1).isin(*_TRUE)
    elif base in _NUMBERS or base == "decimal":
        made = number(text).try_cast(f.type)
    elif f.format and base in ("date", "timestamp", "timestamp_ntz"):
        made = F.try_to_timestamp(text, F.lit(f.format)).cast(f.type)
    else:
        made = text.try_cast(f.type)
    said = F.concat(F.lit(f"{f.name} can't be read as {f.type}: "), text)
    empty = F.coalesce(text, F.lit("")) == ""
    value = F.when(empty, F.lit(f.default).cast(f.type)).when(made.isNotNull(), made).otherwise(F.raise_error(said).cast(f.type))
    return value.alias(f.name)


def number(text: Column) -> Column:
    """Text of a number without thousands separators and currency signs; a
    sign at the end or brackets around it count as well."""
    bare = F.regexp_replace(text, r"[,\s$€£¥]", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.endswith("-")
    digits = F.regexp_replace(bare, r"[()+]|-$", "")
    return F.when(negative, F.concat(F.lit("-"), F.regexp_replace(digits, "^-", ""))).otherwise(digits)


def read_delimited(spark: SparkSession, path: str, record: TextRecord) -> DataFrame:
    """Delimited text by Spark's reader: quoted delimiters, doubled quotes."""
    positions = record.positions()
    width = max(positions) + 1
    schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(width)])
    raw = spark.read.csv(
        path, schema=schema, sep=record.delimiter, quote=record.qualifier or "\0", escape=record.qualifier or "\0", header=record.header, enforceSchema=True, mode="PERMISSIVE"
    )
    return raw.select(*[_typed(f, F.col(f"_c{p}")) for f, p in zip(record.fields, positions, strict=True)])


def split_line(line: str, delimiter: str, qualifier: str) -> list[str]:
    """The strict rules: a qualifier opens a quoted part and drops what stood
    before it; doubled it stands for itself, unless a delimiter or the end
    follows, where it closes."""
    fields, part, inside, k = [], [], False, 0
    while k < len(line):
        char = line[k]
        if inside:
            if char == qualifier:
                if line[k + 1 : k + 2] == qualifier and line[k + 2 : k + 3] not in ("", delimiter):
                    part.append(qualifier)
                    k += 1
                else:
                    inside = False
            else:
                part.append(char)
        elif qualifier and char == qualifier:
            inside, part = True, []
        elif char == delimiter:
            fields.append("".join(part))
            part = []
        else:
            part.append(char)
        k += 1
    return [*fields, "".join(part)]


def read_strict(spark: SparkSession, path: str, record: TextRecord, line_filter: Callable[[int, str], bool] | None = None, stop_at_blank: bool = False) -> DataFrame:
    """Delimited text by the strict rules.

    ``line_filter`` sees the number of a line in its file, from 0. It and
    ``stop_at_blank`` need lines in order, so each file is then one task.
    """
    positions, delimiter, qualifier = record.positions(), record.delimiter, record.qualifier
    ordered = line_filter is not None or stop_at_blank or record.header
    lines = spark.read.text(path, wholetext=ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = enumerate(text.splitlines() if ordered else [text])
                if record.header:
                    next(rows, None)
                if stop_at_blank:
                    rows = takewhile(lambda x: x[1] != "", rows)
                made = [split_line(line, delimiter, qualifier) for k, line in rows if line and (line_filter is None or line_filter(k, line))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.string()))], ["cells"])

    cells = map_arrow(lines, run, "cells array<string>")
    return cells.select(*[_typed(f, F.get("cells", F.lit(p))) for f, p in zip(record.fields, positions, strict=True)])


def header_names(names: list[str], lower: bool = False) -> list[str]:
    """Column names from a header: what is no word character becomes ``_``."""
    made = [re.sub(r"\W", "_", n.strip()) for n in names]
    return [n.lower() for n in made] if lower else made


def read_dynamic(spark: SparkSession, path: str, delimiter: str = ",", qualifier: str = '"', lower: bool = False) -> DataFrame:
    """Delimited text whose first line names the columns; all are text."""
    df = spark.read.csv(path, sep=delimiter, quote=qualifier, escape=qualifier, header=True)
    return df.toDF(*header_names(df.columns, lower))


def read_fixed(spark: SparkSession, path: str, record: TextRecord) -> DataFrame:
    """Fixed-width text; short lines are accepted, skipped or an error."""
    spans = record.spans()
    least = max(start + (length or 1) for start, length in spans)
    lines = spark.read.text(path).filter("value <> ''")
    if record.short_lines == "skip":
        lines = lines.filter(F.length("value") >= least)
    value = F.col("value")
    if record.short_lines == "raise":
        said = F.concat(F.lit(f"a line is shorter than {least}: "), value)
        value = F.when(F.length(value) >= least, value).otherwise(F.raise_error(said).cast("string"))
    cells = [F.substr(value, F.lit(start + 1), F.lit(length)) if length else F.substr(value, F.lit(start + 1)) for start, length in spans]
    return lines.select(*[_typed(f, c) for f, c in zip(record.fields, cells, strict=True)])


def _written(f: TextField, value: Column) -> Column:
    base = f.type.split("(")[0]
    if f.type == "boolean":
        yes, no = (f.format or "true|false").split("|")
        made = F.when(value, yes).otherwise(no)
    elif f.format and base in ("date", "timestamp", "timestamp_ntz"):
        made = F.date_format(value, f.format)
    elif f.format and (base in _NUMBERS or base == "decimal"):
        made = F.format_number(value, f.format)
    else:
        made = value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), made), F.lit(""))


def delimited_lines(df: DataFrame, record: TextRecord, qualify_all: bool = False) -> DataFrame:
    """Lines as a column ``value``; texts are qualified, qualifiers doubled."""
    positions, q = record.positions(), record.qualifier
    cells = [F.lit("")] * (max(positions) + 1)
    for f, p in zip(record.fields, positions, strict=True):
        cell = _written(f, F.col(quoted(f.name)))
        if q and (qualify_all or f.type.split("(")[0] == "string"):
            cell = F.concat(F.lit(q), F.replace(cell, F.lit(q), F.lit(q + q)), F.lit(q))
        cells[p] = cell
    return df.select(F.concat_ws(record.delimiter, *cells).alias("value"))


def fixed_lines(df: DataFrame, record: TextRecord) -> DataFrame:
    """Lines as a column ``value``; fields are cut and padded to their length."""
    parts, at = [], 0
    for f, (start, length) in sorted(zip(record.fields, record.spans(), strict=True), key=lambda x: x[1][0]):
        cell = _written(f, F.col(quoted(f.name)))
        parts += [F.lit(" " * (start - at))] if start > at else []
        parts.append(F.rpad(F.substring(cell, 1, length), length, " ") if length else cell)
        at = start + (length or 0)
    return df.select(F.concat(*parts).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)
