"""Related rows in bulk: one join where an object mapper asks once a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcraft.operators.entity import quoted


def children(parents: DataFrame, parent_keys: list[str], kids: DataFrame, kid_keys: list[str], name: str = "children") -> DataFrame:
    """Parents with an array of their child rows; empty if there are none.

    Children with a null key, or of no parent here, are left out. Memory holds
    one parent's children at a time; for unbounded families use ``attached``.
    """
    rows = attached(parents, parent_keys, kids, kid_keys)
    grouped = rows.groupBy(*[quoted(k) for k in kid_keys]).agg(F.collect_list(F.struct("*")).alias(name))
    renamed = grouped.select(*[F.col(quoted(k)).alias(f"_k{n}") for n, k in enumerate(kid_keys)], name)
    on = [F.col(quoted(p)) == F.col(f"_k{n}") for n, p in enumerate(parent_keys)]
    schema = renamed.schema[name].dataType.simpleString()
    joined = parents.join(renamed, on, "left").withColumn(name, F.coalesce(name, F.array().cast(schema)))
    return joined.select(*[F.col(quoted(c)) for c in parents.columns], name)


def attached(parents: DataFrame, parent_keys: list[str], kids: DataFrame, kid_keys: list[str]) -> DataFrame:
    """The child rows of the given parents, one row each."""
    asked = parents.select(*[F.col(quoted(k)).alias(f"_p{n}") for n, k in enumerate(parent_keys)]).distinct()
    return kids.join(asked, [F.col(quoted(k)) == F.col(f"_p{n}") for n, k in enumerate(kid_keys)], "left_semi")


def reference(kids: DataFrame, kid_keys: list[str], parents: DataFrame, parent_keys: list[str], name: str = "parent", order_by: str | None = None) -> DataFrame:
    """Children with their parent as a struct, null if there is none.

    Where a parent key is repeated, the last in order of ``order_by`` counts;
    without it any one does.
    """
    row = F.struct(*[F.col(quoted(c)) for c in parents.columns])
    one = F.max_by(row, F.col(quoted(order_by))) if order_by else F.any_value(row)
    unique = parents.groupBy(*[F.col(quoted(k)).alias(f"_k{n}") for n, k in enumerate(parent_keys)]).agg(one.alias(name))
    joined = kids.join(unique, [F.col(quoted(k)) == F.col(f"_k{n}") for n, k in enumerate(kid_keys)], "left")
    return joined.select(*[F.col(quoted(c)) for c in kids.columns], name)
