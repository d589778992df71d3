"""Document fingerprints from spot signatures (SpotSigs).

A spot is a common word and the chain of content words that follows it. The set
of a text's spots, hashed to 32 bits, is its fingerprint: frequent words anchor
it, and templates without running text hardly count. Likeness is the Jaccard
coefficient of two sets; the ratio of their lengths bounds it from above, which
prunes a comparison before the sets are read.

``with_next`` pairs each document with the next in descending order of
``doc_id``. Documents are dealt to ranges of ``doc_id`` and sorted there; the
first document of a range also goes to the range before it, so no order over
the whole table is ever built and each text is shuffled once. Documents of one
very frequent ``doc_id`` are split among ranges by the hash that orders them.
Rows that are wholly equal are one row with a count before anything is sorted:
each of them is the next of the one before it.

Defined results
    null or empty text: 0 characters; the fingerprint of the empty text.
    Where common words are far apart, content words start chains themselves. A
    text without any spot: chains start at every word. Without words: the hash
    of the text is its one signature.
    null ``doc_id``: after all others. Equal ``doc_id``: ordered by a hash of
    the text. One row: it is its own next. Empty table: no rows. Very long text:
    read whole. A likeness that the lengths keep below ``PRUNED`` is 0.
    Only ``doc_id`` and ``text`` are read, so clashing columns cannot matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm.quality_rules import STOP_WORDS
from rowcraft.llm.support import materialise, to_every_task

CHAIN = 2
#: Two sets whose lengths can't give this likeness are not compared.
PRUNED = 0.05
#: Wholly equal rows up to this number of kinds are sent to every task.
MOST_BROADCAST = 200_000
#: Signatures of more than this share of all sets are not shuffled by value.
FREQUENT = 0.001
#: A content word this many after the last anchor anchors a spot itself, so
#: that text with few common words is covered too.
FAR = 4
#: Ranges of ``doc_id`` for each shuffle partition; more of them even out.
RANGES = 4

_ANCHORS = frozenset(w.encode() for w in STOP_WORDS)
_TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LEAST = -(1 << 63)
_ROUNDING = 1e-9


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct signatures of a whole text.

    The k-th occurrence of a spot is a signature of its own, so the Jaccard
    coefficient of two such sets is that of the multisets of spots.
    """
    words = [w for w in (raw.strip(_TRIM) for raw in text.lower().encode().split()) if w]
    content, anchors, since = [], [], 0
    for word in words:
        if word in _ANCHORS:
            anchors.append((word, len(content)))
            since = 0
        else:
            if since >= FAR:
                anchors.append((b"", len(content)))
            since += 1
            content.append(word)
    n = len(content)
    spots = [anchor + b" " + b" ".join(content[at : at + chain]) for anchor, at in anchors if at < n]
    if not spots:
        spots = [b" ".join(words[i : i + chain]) for i in range(len(words))] or [text.encode()]
    seen: dict[bytes, int] = {}
    found = []
    for spot in spots:
        k = seen[spot] = seen.get(spot, -1) + 1
        found.append(zlib.crc32(spot, k))
    return np.unique(np.array(found, dtype=">u4"))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two signature sets; 0 if it can't reach ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(found: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits a signature."""
    return found.astype(">u4").tobytes().hex()


def _counted(rows: DataFrame) -> DataFrame:
    """Distinct (key, tie, body) with their number ``n``; only repeated ones are grouped."""
    known = ["key", "tie"]
    many = to_every_task(rows.groupBy(*known).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "equal-rows", MOST_BROADCAST)
    once = rows.withColumn("n", F.lit(1).cast("long"))
    if many.isEmpty():
        return once
    grouped = rows.join(many, known).groupBy(*known, "n").agg(F.any_value("body").alias("body"))
    return once.join(many.select(*known), known, "left_anti").unionByName(grouped)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(place, guest, key, tie, body, n) sorted so that each row's next follows it.

    ``n`` rows are wholly equal. Rows with ``guest`` are there only to be the
    next of the row before.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or RANGES * partitions
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    rows = _counted(docs.select(key.alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("body")).withColumn("tie", F.xxhash64("body")))
    # Only the balance of the ranges depends on these, not the result.
    points = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("key", points, 10 * ranges)).first()[0] if points else []
    edges = np.sort(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def place(keys: pd.Series, ties: pd.Series) -> pd.Series:
        k = keys.to_numpy(dtype=np.int64)
        below, upto = np.searchsorted(edges, k, side="left"), np.searchsorted(edges, k, side="right")
        # A key that fills several ranges is split among them by its ties.
        part = np.floor((ties.to_numpy(dtype=np.float64) / 2.0**64 + 0.5) * (upto - below)).astype(np.int64) + 1
        return pd.Series(len(edges) - below - np.minimum(part, upto - below)).astype("int32")

    placed = rows.withColumn("place", place("key", "tie"))
    # One row a range: the first of it, and the range that needs it as a guest.
    heads = placed.groupBy("place").agg(F.max(F.struct("key", "tie")).alias("head"))
    found = sorted((r["place"], r["head"]["key"], r["head"]["tie"]) for r in heads.collect())
    wanted = [(key_, tie, found[k - 1][0]) for k, (_, key_, tie) in enumerate(found)]
    guests = F.broadcast(spark.createDataFrame(wanted, "head_key long, head_tie long, host int"))
    joined = placed.join(guests, (F.col("key") == F.col("head_key")) & (F.col("tie") == F.col("head_tie")), "left")
    stay = F.struct(F.col("place").alias("place"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("place"), F.lit(True).alias("guest"))
    dealt = joined.select("key", "tie", "body", "n", F.explode(F.when(F.col("host").isNull(), F.array(stay)).otherwise(F.array(stay, visit))).alias("at"))
    dealt = dealt.select("at.place", "at.guest", "key", "tie", "body", "n").repartition(partitions, "place")
    return dealt.sortWithinPartitions("place", "guest", F.desc("key"), F.desc("tie"))


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def edited(text: str, following: str) -> str:
    """A text whose last third is replaced by the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_edits(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for place, guest, key, body, n in zip(*(batch.column(k) for k in range(5)), strict=True):
                here = (place.as_py(), guest.as_py(), key.as_py(), text := body.as_py(), signatures(text, chain))
                if held is not None and held[0] == here[0] and not held[1]:
                    out.append(_row(held, here, chain))
                if not here[1] and n.as_py() > 1:
                    again = _row(here, here, chain)
                    for low in range(0, n.as_py() - 1, 1000):
                        yield made([again] * min(1000, n.as_py() - 1 - low))
                held = here
            if out:
                yield made(out)
                out = []

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_next(docs).select("place", "guest", "key", "body", "n"), run, fields)


def _row(own: tuple, following: tuple, chain: int) -> tuple:
    _, _, key, text, found = own
    changed = edited(text, following[3])
    other = signatures(changed, chain)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return (None if key == _LEAST else key, len(text), digest, written(found), written(other), likeness(found, other, PRUNED), likeness(found, following[4], PRUNED))


def _by_rarity(classes: DataFrame) -> DataFrame:
    """(set_key, n, ordered): the signatures of each set, those of few sets first.

    Any one order of all signatures finds all links; with the rare ones first few
    sets meet. The most frequent signatures are not shuffled by their value: no
    more than ``1 / FREQUENT`` times the mean size of a set can be that frequent.
    """
    each = classes.select("set_key", F.explode("spots").alias("spot"))
    counts = materialise(each.groupBy("spot").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "spot-counts")
    least = FREQUENT * classes.count()
    frequent = to_every_task(counts.filter(F.col("c") > least), "frequent-spots", MOST_BROADCAST)
    others = each.join(frequent, "spot", "left_anti").join(counts.filter(F.col("c") <= least), "spot", "left")
    known = each.join(frequent, "spot").unionByName(others)
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "spot"))).alias("ordered")
    return known.groupBy("set_key").agg(ordered).select("set_key", F.size("ordered").alias("n"), F.col("ordered.spot").alias("ordered"))


def similar(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates: (doc_id, set_key, class_id), and links (a_key, b_key, a, b, likeness).

    A class is all documents of one signature set, known by its ``set_key``; its
    id is their least ``doc_id``, null if they have none. Sets are partitioned by
    length so that only neighbouring partitions can reach the threshold. Within
    them two sets meet where they share a signature of their prefixes, rarest
    first; sets this alike must share one. What is left of both sets after the
    place where they meet must be enough, or they are not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signatures(t.as_py() or "", chain).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "spots"])

    sets = map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, spots array<long>")
    sets = materialise(sets.withColumn("set_key", F.sha2(F.array_join(F.transform("spots", lambda s: s.cast("string")), ","), 256)), "spot-sets")
    classes = materialise(sets.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("spots").alias("spots")), "spot-classes")
    members = sets.select("doc_id", "set_key").join(classes.select("set_key", "class_id"), "set_key").select("doc_id", "set_key", "class_id")
    n, width = F.col("n"), math.log(1 / threshold)
    # Bounds are a little wider, so that rounding can't lose a link.
    part = F.floor(F.log(n.cast("double")) / width + _ROUNDING).alias("part")
    prefix = F.slice("ordered", 1, n - F.ceil(n * threshold - _ROUNDING).cast("int") + 1)
    left = materialise(_by_rarity(classes).select("set_key", "n", part, F.posexplode(prefix).alias("at", "spot")), "prefixes")
    right = left.select(F.col("set_key").alias("b_key"), F.col("n").alias("m"), F.col("at").alias("b_at"), F.col("part").alias("b_part"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "spot")
    once = (F.col("part") != F.col("b_part")) | (F.col("set_key") < F.col("b_key"))
    lengths = F.least("n", "m") >= threshold * F.greatest("n", "m") - _ROUNDING
    enough = F.least(n - F.col("at"), F.col("m") - F.col("b_at")) >= threshold / (1 + threshold) * (n + F.col("m")) - _ROUNDING
    meet = left.join(right, ["part", "spot"]).filter(once & lengths & enough)
    pairs = meet.select(F.least("set_key", "b_key").alias("a_key"), F.greatest("set_key", "b_key").alias("b_key")).distinct()
    one, two = (classes.select(F.col("set_key").alias(f"{k}_key"), F.col("class_id").alias(f"{k}_id"), F.col("spots").alias(f"{k}_spots")) for k in "ab")
    both = F.size(F.array_intersect("a_spots", "b_spots"))
    alike = (both / (F.size("a_spots") + F.size("b_spots") - both)).alias("likeness")
    scored = pairs.join(one, "a_key").join(two, "b_key").select("a_key", "b_key", F.least("a_id", "b_id").alias("a"), F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.greatest("a_id", "b_id")).alias("b"), alike)
    return members, scored.filter(F.col("likeness") >= threshold)
