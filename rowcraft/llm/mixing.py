"""Mixing sources to target weights, with built-in functions only.

Words are summed per source, the target of each source is a share of all words
by weight, and each document is emitted ``floor(rate)`` times plus one more
time with the fraction of the rate as probability. The draw is a hash of the
document, so a rerun, a retried task or another partitioning gives the same mix.

Targets stop at ``max_rate`` times a source's size. The excess goes to the
other sources by weight until none is above. That fixed point is the level L
with sum(min(cap, L * weight)) = total: sorted by cap / weight, a prefix of the
sources is at its cap and the rest share what is left.

Only the table of sources (one row each) is ever ordered as a whole.

Defined results
    null text: size 0; null source: a source of its own, ordered last.
    A source whose size is 0 has target 0; its documents are not emitted.
    null ``doc_id`` and repeated rows: equal rows share one draw.
    Empty table: no rows. Very long texts: counted whole, and emitted at most
    ``max_rate`` times. Sources whose cap / weight are equal: by name.
    Clashing column names: the mix is computed beside the row, not in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowcraft.llm.support import to_every_task, words

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix-1"

#: Up to so many sources their table goes to every task, so that documents stay
#: where they are; beyond it they are joined by source.
MOST_BROADCAST_SOURCES = 50_000

#: Bits of a draw; a double holds them exactly.
_DRAW_BITS = 52


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the document's id and text."""
    key = F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, _DRAW_BITS // 4), 16, 10).cast("long").cast("double") / float(1 << _DRAW_BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    placed = by_source.withColumn("_weight", weight.cast("long")).withColumn("_cap", max_rate * F.col("source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), F.asc_nulls_last("source"))
    placed = placed.withColumns(
        {
            "_total": F.sum("source_size").over(whole),
            "_spent": F.coalesce(F.sum("_cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_left": F.sum("_weight").over(before.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # Were this source the first below its cap, the level would be this one.
    placed = placed.withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_left"))
    fits = F.col("_level") * F.col("_weight") <= F.col("_cap")
    placed = placed.withColumn("_answer", F.min(F.when(fits, F.struct((F.col("_cap") / F.col("_weight")).alias("r"), F.col("_level").alias("v")))).over(whole)["v"])
    share = F.coalesce(F.col("_answer"), F.lit(0.0)) * F.col("_weight")
    return placed.select("source", "source_size", F.least(share, F.col("_cap").cast("double")).alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, n_copies, and the row itself as ``_row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(
        F.col("doc_id"), F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"), draw(seed).alias("_draw"), row.alias("_row")
    )
    goal = targets(sized.select("source", "size"), weights, max_rate).withColumnRenamed("source", "_source")
    goal = to_every_task(goal, "targets", MOST_BROADCAST_SOURCES)
    joined = sized.join(goal, F.col("source").eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    n = whole + F.when(F.col("_draw") < rate - whole, 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", n.cast("long").alias("n_copies"), "_row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it."""
    taken = copies(docs, weights, max_rate, seed).filter("n_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select("_row.*")
