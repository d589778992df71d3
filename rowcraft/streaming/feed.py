"""Entity maps and saves on streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from rowcraft.functions.predicate import where
from rowcraft.operators import dml
from rowcraft.operators.entity import EntityMap
from rowcraft.operators.store import Store


def mapped(stream: DataFrame, of: EntityMap, predicate: Callable[[Any], Any] | None = None) -> DataFrame:
    """Mapped columns of a stream's rows that match; stateless."""
    return of.project(where(stream, of, predicate) if predicate else stream)


def upsert_into(stream: DataFrame, of: EntityMap, store: Store, checkpoint: str) -> DataStreamWriter:
    """Saves each batch: rows whose key is stored are updated, others added.

    A batch that is replayed after a failure gives the same table. Rows of one
    batch that share a key fail, so each key should occur once. Every batch
    rewrites the table, and versions before the last two go: this suits tables of
    moderate size; a large one belongs in a table format with its own merge.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table = store.read(of.target)
        changed = dml.changes(batch, of.project(table), of)
        state, _ = dml.save(table, of, changed, "key", "all", False)
        store.replace(of.target, state)
        store.vacuum()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
