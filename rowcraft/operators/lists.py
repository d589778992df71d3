"""Result shapers: arrays, pairs, dictionaries, delimited text, XML.

The first form of each is a DataFrame, so that shaping runs in Spark; the
``get_`` form collects it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import batched
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcraft.operators import filters, params
from rowcraft.operators.entity import quoted


def _nth(df: DataFrame, n: int) -> Column:
    return F.col(quoted(df.columns[n]))


def filtered(df: DataFrame, *asked: filters.Filter) -> DataFrame:
    """A query's result, filtered from outside if there are filters."""
    return filters.apply(df, *asked) if asked else df


def first_column(df: DataFrame, type: str | None = None) -> DataFrame:
    value = _nth(df, 0)
    return df.select((value.cast(type) if type else value).alias("value"))


def get_array(df: DataFrame, type: str | None = None) -> list[Any]:
    return [r[0] for r in first_column(df, type).collect()]


def strings(df: DataFrame, prepend_empty: bool = False) -> DataFrame:
    """First column as text, null as empty; with a leading empty text, blanks go."""
    out = df.select(F.coalesce(_nth(df, 0).cast("string"), F.lit("")).alias("value"))
    if not prepend_empty:
        return out
    return df.sparkSession.range(1).select(F.lit("").alias("value")).unionByName(out.filter("value <> ''"))


def get_string_array(df: DataFrame, prepend_empty: bool = False) -> list[str]:
    return [r[0] for r in strings(df, prepend_empty).collect()]


def delimited(df: DataFrame, delimiter: str = ",", qualifier: str = "") -> DataFrame:
    """One text of all values of the first column, in ascending order.

    The text is one value of one row, so this is for lists that fit in it; for
    larger ones see ``delimited_pieces``.
    """
    value = F.concat(F.lit(qualifier), _nth(df, 0).cast("string"), F.lit(qualifier))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(_nth(df, 0).alias("k"), value.alias("v")))), lambda x: x["v"]), delimiter)
    return df.filter(_nth(df, 0).isNotNull()).agg(joined.alias("value"))


def delimited_pieces(df: DataFrame, delimiter: str = ",", qualifier: str = "", pieces: int | None = None) -> DataFrame:
    """The same text in numbered pieces (piece, value), one a range of values.

    Joined by the delimiter in order of their numbers they are ``delimited``.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(_nth(df, 0).alias("k")).filter("k is not null").repartitionByRange(n, "k").select("k", F.spark_partition_id().alias("piece"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda x: F.concat(F.lit(qualifier), x.cast("string"), F.lit(qualifier))), delimiter)
    return ranged.groupBy("piece").agg(joined.alias("value"))


def get_delimited_string(df: DataFrame, delimiter: str = ",", qualifier: str = "") -> str:
    return delimited(df, delimiter, qualifier).first()[0]


def pairs(df: DataFrame) -> DataFrame:
    """(id, label) from the first two columns."""
    return df.select(_nth(df, 0).alias("id"), _nth(df, 1).cast("string").alias("label"))


def get_data_list(df: DataFrame) -> list[tuple[Any, str]]:
    return [tuple(r) for r in pairs(df).collect()]


def dictionary(df: DataFrame) -> DataFrame:
    """One map from the first column to the second; a repeated key is an error."""
    entries = F.collect_list(F.struct(_nth(df, 0), _nth(df, 1)))
    keys = F.transform(entries, lambda e: e[df.columns[0]])
    unique = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(F.raise_error("a key of the dictionary is repeated"))
    return df.agg(F.map_from_entries(unique).alias("value"))


def entries(df: DataFrame) -> DataFrame:
    """The dictionary as rows (key, value), for any size; a repeated key is an error."""
    said = F.concat(F.lit("a key of the dictionary is repeated: "), F.col("key").cast("string"))
    grouped = df.select(_nth(df, 0).alias("key"), _nth(df, 1).alias("value")).groupBy("key").agg(F.any_value("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return grouped.select("key", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(said)).alias("value"))


def get_dictionary(df: DataFrame) -> dict[Any, Any]:
    return dict(dictionary(df).first()[0])


def xml(df: DataFrame, row_tag: str = "row") -> DataFrame:
    """Each row as an XML element; binary columns in Base64."""
    made = [F.base64(quoted(n)).alias(n) if t == "binary" else F.col(quoted(n)) for n, t in df.dtypes]
    return df.select(F.to_xml(F.struct(*made), {"rowTag": row_tag}).alias("value"))


def xml_document(df: DataFrame, root_tag: str = "rows", row_tag: str = "row") -> str:
    """All rows under one root; for results that fit in one text."""
    body = "".join(r[0] for r in xml(df, row_tag).collect())
    return f"<{root_tag}>{body}</{root_tag}>"


def split(values: Iterable[Any], size: int = 2000) -> Iterator[tuple]:
    """Values in lists of at most ``size``; Spark needs none, other systems may."""
    return batched(values, size)


def scalar(df: DataFrame) -> Any:
    """First column of the first row, None if there is none."""
    row = df.select(_nth(df, 0)).limit(1).collect()
    return row[0][0] if row else None


def data_set(spark: SparkSession, statements: Sequence[str], values: Sequence[Any] = ()) -> dict[str, DataFrame]:
    """Several statements as Table1, Table2 and so on."""
    return {f"Table{k}": params.query(spark, text, values) for k, text in enumerate(statements, 1)}
