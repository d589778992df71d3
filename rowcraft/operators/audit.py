"""What a batch changes, and what stands in its way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.operators.entity import EntityMap, quoted


def _text(side: str, name: str) -> Column:
    return F.col(f"{side}.{quoted(name)}").cast("string")


def audit(batch: DataFrame, of: EntityMap) -> DataFrame:
    """(key, state, property, old, new), one row a changed field.

    Keys of more than one field are joined by a comma.
    """
    stored = [f for f in of.fields if not f.expression and not f.row_version and f.comparable]
    key = F.concat_ws(",", *[F.coalesce(_text("_new", f.source), _text("_orig", f.source)) for f in of.all_keys])
    entries = F.array(*[F.struct(F.lit(f.name).alias("property"), _text("_orig", f.source).alias("old"), _text("_new", f.source).alias("new")) for f in stored])
    rows = batch.filter(F.col("_state").isin("Added", "Modified")).select(key.alias("key"), F.col("_state").alias("state"), F.explode(entries).alias("c"))
    return rows.filter(~F.col("c.old").eqNullSafe(F.col("c.new"))).select("key", "state", "c.property", "c.old", "c.new")


def audit_xml(batch: DataFrame, of: EntityMap) -> DataFrame:
    """(key, changes): the changed fields of each row as one XML element."""
    change = F.struct("property", "old", "new")
    return audit(batch, of).groupBy("key").agg(F.to_xml(F.struct(F.sort_array(F.collect_list(change)).alias("change")), {"rowTag": "changes"}).alias("changes"))


def conflicts(base: DataFrame, of: EntityMap, batch: DataFrame) -> DataFrame:
    """(key, property, original, current, attempted) of fields that others changed."""
    stored = [f for f in of.fields if not f.expression and not f.row_version and f.comparable]
    rows = base.select(F.struct(*[F.col(quoted(c)) for c in base.columns]).alias("_base"))
    met = batch.join(rows, [F.col(f"_base.{quoted(f.source)}") == F.col(f"_orig.{quoted(f.source)}") for f in of.all_keys])
    key = F.concat_ws(",", *[_text("_orig", f.source) for f in of.all_keys])
    entries = F.array(*[F.struct(F.lit(f.name).alias("property"), *[_text(s, f.source).alias(n) for s, n in (("_orig", "original"), ("_base", "current"), ("_new", "attempted"))]) for f in stored])
    found = met.select(key.alias("key"), F.explode(entries).alias("c"))
    return found.filter(~F.col("c.original").eqNullSafe(F.col("c.current"))).select("key", "c.*")
