"""SimHash near-duplicates: fingerprints, exact links, components.

Fingerprints are made where the text is; only 8 bytes a document travel.
Equal fingerprints are one row before anything is compared. Fingerprints within
two bits agree in three of five blocks of their bits, so each is sent to ten
buckets, one for each choice of three blocks. A bucket shares 38 bits or more:
its size is bounded by what the other 26 bits can spell, not by the corpus.
Within a bucket they are compared bit-sliced (``bitslice``), and only the links
that connect it leave it. Components of fingerprints then give those of the
documents.

Defined results
    null or blank text: fingerprint zero, linked like any other.
    null ``doc_id``: never the least of a component; null if there is no other.
    Repeated rows: each gets the same component. Empty table: no rows.
    Very long texts: read whole, hashed shingle by shingle.
    Only ``doc_id`` and ``text`` are read, so clashing columns cannot matter.
    ``similar_texts`` has the stage that removes near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm import bitslice
from rowcraft.llm.components import components
from rowcraft.llm.support import materialise

SHINGLE = 3
SEED = 42

#: Bits of the five blocks, lowest first.
_BLOCKS = (13, 13, 13, 13, 12)


def _masks() -> list[int]:
    """Of each choice of three blocks, the mask, as a signed long."""
    low, parts = 0, []
    for width in _BLOCKS:
        parts.append(((1 << width) - 1) << low)
        low += width
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in combinations(parts, 3))]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # bytes: lowers A-Z only, cuts at ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < shingle:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(shingle))))  # noqa: B905  the shortest ends it
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 14):
        part = hashes[low : low + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as binary) as text"), run, "doc_id long, fp long")


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that come sorted by (choice, key, fp)."""
    held = [np.empty(0, np.int64)] * 3

    def linked(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp.view(np.uint64), key, choice))
        choice, key, fp = choice[order], key[order], fp[order]
        cut = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
        sizes = np.diff(np.concatenate(([0], cut, [len(fp)])))
        u, v = bitslice.links(fp.view(np.uint64), sizes)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        columns = [np.concatenate((h, c.to_numpy().astype(np.int64))) for h, c in zip(held, batch.columns, strict=True)]
        choice, key, _ = columns
        cut = np.flatnonzero((choice != choice[-1]) | (key != key[-1])) if len(key) else []
        whole = int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on
        if whole:
            yield linked(*(c[:whole] for c in columns))
        held = [c[whole:] for c in columns]
    if len(held[0]):
        yield linked(*held)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints within two bits."""
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(_masks())])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select(F.col("k.choice").cast("long").alias("choice"), "k.key", "fp")
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(partitions, "choice", "key").sortWithinPartitions("choice", "key")
    return map_arrow(dealt, _bucket_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id), one row a document."""
    prints = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct))
    rooted = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")
