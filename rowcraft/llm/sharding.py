"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``replicas`` virtual nodes on a ring of 64-bit positions. A
row belongs to the arc of the first node at or after its hash. A shard holds at
most its capacity; the rows of an arc that find their shard full continue
clockwise to the next shard with room. With capacities that add up to the
number of rows the law is ``rows``: shard sizes are at most one apart. Moving
from n to n + 1 shards moves little more than the new shard's share.

Which rows of an arc overflow is decided by their rank in it, so the plan needs
only the row counts of the arcs. It is made for ``shards * replicas`` arcs, a
number set by parameters, whatever the number of rows. Ranks come from counts of
small cells (an arc cut by hash) and a sort within each cell.

Rows that agree in all that is known of them are counted before anything is
shuffled, so a row repeated for a third of the table is a few rows with counts.

Defined results
    null text: size 1 (no bytes plus 1), CRC-32 of the empty text.
    null ``doc_id``: placed by its text like any other row.
    Repeated rows: one slot each. Empty table: no rows.
    Only ``doc_id`` and ``text`` are read, so clashing columns cannot matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowcraft.llm.support import materialise

SHARDS = 16
REPLICAS = 128

#: Rows a cell should hold, about; cells are the unit of sorting.
CELL_ROWS = 20_000


def ring(shards: int = SHARDS, replicas: int = REPLICAS) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes in order, and the shard of each."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big", signed=True), shard)
        for shard in range(shards)
        for k in range(replicas)
    )
    return [x for x, _ in nodes], [s for _, s in nodes]


def arc_of(positions: list[int], key: int) -> int:
    """The arc of a hash: the first node at or after it, clockwise."""
    return bisect_left(positions, key) % len(positions)


def plan(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all rows.

    All arcs fill their own shard first, in ring order; what is left of an arc
    then walks clockwise to the shards with room.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    held = [0] * shards
    out = []

    def put(arc: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - held[shard])
        if n > 0:
            out.append((arc, first, first + n, shard, held[shard]))
            held[shard] += n
        return max(n, 0)

    done = [put(arc, 0, n, owners[arc]) for arc, n in enumerate(counts)]
    for arc, n in enumerate(counts):
        step = 1
        while done[arc] < n:
            done[arc] += put(arc, done[arc], n - done[arc], owners[(arc + step) % len(owners)])
            step += 1
    return out


_PLAN = T.StructType([T.StructField("_arc", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in ("_from", "_to", "_shard", "_base")])


def assign(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    spark = docs.sparkSession
    positions, owners = ring(shards, replicas)
    edges = np.array(positions, dtype=np.int64)

    @F.pandas_udf("int")
    def arc(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(dtype=np.int64)) % len(edges)).astype("int32")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    # A row repeated without end is cut into chunks that spread over the ring.
    last = F.floor((F.col("_n") - 1) / CELL_ROWS)
    chunks = alike.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    chunks = chunks.withColumn("_n", F.least(F.lit(CELL_ROWS).cast("long"), F.col("_n") - F.col("_chunk") * CELL_ROWS))
    keyed = chunks.withColumn("_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32", "_chunk")).drop("_chunk")
    keyed = materialise(keyed.withColumn("_arc", arc("_key")), "shard-keys")
    per_arc = {r["_arc"]: r["n"] for r in keyed.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    counts = [per_arc.get(a, 0) for a in range(len(owners))]
    # Cells are cut finer as the table grows, so that none outgrows a task.
    cells = max(1, -(-sum(counts) // (len(owners) * CELL_ROWS)))
    keyed = keyed.withColumn("_cell", F.pmod(F.xxhash64("_key"), F.lit(cells)))
    in_arc = Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("_arc", "_cell").agg(F.sum("_n").alias("_rows"))
    starts = starts.select("_arc", "_cell", F.coalesce(F.sum("_rows").over(in_arc), F.lit(0)).alias("_start"))
    in_cell = Window.partitionBy("_arc", "_cell").orderBy("_key", F.asc_nulls_last("doc_id"), "size", "text_crc32")
    before = F.coalesce(F.sum("_n").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("_before", before).join(starts, ["_arc", "_cell"])
    first = F.col("_start") + F.col("_before")
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(first, first + F.col("_n") - 1)))
    # At most a few intervals an arc: its size follows from the parameters.
    intervals = F.broadcast(spark.createDataFrame(plan(counts, owners, shards), _PLAN).withColumnRenamed("_arc", "_at"))
    placed = ranked.join(intervals, (F.col("_arc") == F.col("_at")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select("doc_id", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (F.col("_base") + F.col("_rank") - F.col("_from")).alias("slot"))
