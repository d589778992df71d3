"""SimHash near-dedup of texts that are 0.8 alike in five-word shingles.

``simhash`` finds fingerprints within two of 64 bits, as its query's contract
asks; texts of a cosine of 0.8 differ in a fifth of their bits. So here a
fingerprint has 512 bits, made from the set of distinct shingles. At a cosine of
0.8 two texts differ in 512 * acos(0.8) / pi = 105 bits, with a standard error of
nine; they are linked up to one standard error more.

1.  Texts of one shingle set are one row (a class) before anything is compared.
2.  Blocks of bits can't find neighbours this far apart (fourteen-bit blocks would
    take over seventy copies of each row), so classes meet in buckets of their
    least shingle hashes: twenty keys of four minima, of which a pair at a cosine
    of 0.8 shares one with a probability of 0.988. Only buckets of more than one
    class are kept.
3.  Within a bucket fingerprints are compared bit-sliced (``bitslice``), and only
    the links that connect it leave it. Components of all links are the groups.
4.  A bucket of more than ``HOT`` classes is not sent to one task. Its middle is
    the class nearest to the majority of its bits, an aggregate that combines;
    what is linked with the middle is connected and is dealt to parts. What is
    not goes to every part and is compared with all. Nothing is left out.

Defined results
    One row of each group stays: the least ``doc_id``, null last; of rows with
    equal id and text any one, of one id with different texts the one of lesser
    hash if they are linked, else both.
    null or blank text: the empty set, alike only to itself. Fewer words than a
    shingle: the words are one shingle. Very long texts: read whole.
    Empty table: no rows. Columns: all that are given, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm import bitslice
from rowcraft.llm.components import components
from rowcraft.llm.support import materialise, to_every_task

SHINGLE, SEED, THRESHOLD = 5, 42, 0.8
#: 64-bit words of a fingerprint.
WORDS = 8
BANDS, ROWS = 20, 4
#: Classes of a bucket that one task compares; larger buckets are dealt to parts.
HOT = 2048
#: Rows up to this number are sent to every task; more are joined.
MOST_BROADCAST = 200_000

_LAST = (1 << 63) - 1  # stands for a null ``doc_id``
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_CHUNK = 1 << 13
_PRINT = [f"f{k}" for k in range(WORDS)]


def radius(threshold: float = THRESHOLD) -> int:
    """Bits in which two texts of this cosine differ, and one standard error."""
    bits, share = 64 * WORDS, math.acos(threshold) / math.pi
    return int(bits * share + math.sqrt(bits * share * (1 - share)))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # bytes: lowers A-Z only, cuts at ASCII white space only
    if len(tokens) < shingle:
        found = {b" ".join(tokens)} if tokens else set()
    else:
        found = set(map(b" ".join, zip(*(tokens[k:] for k in range(shingle)))))  # noqa: B905  the shortest ends it
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found)))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent hashes, made from the first."""
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles; the least one decides a tie."""
    if not len(found):
        return np.zeros(WORDS, dtype=np.uint64)
    ones, tie = np.zeros(64 * WORDS, dtype=np.int64), None
    for low in range(0, len(found), 255):  # as many as a byte can count
        part = found[low : low + 255]
        many = np.stack([_mixed(part, k) for k in range(WORDS)], axis=1)
        bits = np.unpackbits(many.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        tie = bits[0] if tie is None else tie
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + (tie if len(found) % 2 == 0 else 0) > len(found), bitorder="little").view("<u8")


def bands(found: np.ndarray) -> list[int]:
    """The buckets of a set of shingles; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(found), _CHUNK):
        part = found[low : low + _CHUNK]
        np.minimum(least, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    hashed = [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(hashed, dtype=np.uint64).view(np.int64).tolist()


def _named(docs: DataFrame) -> tuple[Column, Column]:
    """What a row is known by: its place in the order, and its text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, body, key, bands, f0 ...): ``body`` names the text, ``key`` its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingles(t.as_py() or b"", shingle) for t in batch.column(2)]
            keys = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.array([fingerprint(s) for s in sets], dtype=np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(keys), pa.array([bands(s) for s in sets], pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "body", "key", "bands", *_PRINT])

    doc, body = _named(docs)
    rows = docs.select(doc.alias("doc"), body.alias("body"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, "doc long, body long, key long, bands array<long>, " + ", ".join(f"{f} long" for f in _PRINT))


def _bucket_links(within: int):
    """Links of buckets that come sorted by (bucket, part)."""

    def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
        bucket, part, key, *prints = columns
        cut = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0)) + 1
        sizes = np.diff(np.concatenate(([0], cut, [len(key)])))
        root = bitslice.roots(np.stack(prints, axis=1).view(np.uint64), sizes, within)
        other = root != np.arange(len(key))
        return pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(key[root[other]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * (3 + WORDS)
        for batch in batches:
            columns = [np.concatenate((h, c.to_numpy().astype(np.int64))) for h, c in zip(held, batch.columns, strict=True)]
            bucket, part = columns[:2]
            open_ = (bucket == bucket[-1]) & (part == part[-1]) if len(bucket) else bucket.astype(bool)
            if not open_.all():  # the last bucket may go on
                yield linked([c[~open_] for c in columns])
            held = [c[open_] for c in columns]
        if len(held[0]):
            yield linked(held)

    return run


def _distance(one: str, two: str) -> Column:
    return sum((F.bit_count(F.col(f"{one}{f}").bitwiseXOR(F.col(f"{two}{f}"))) for f in _PRINT[1:]), F.bit_count(F.col(f"{one}f0").bitwiseXOR(F.col(f"{two}f0"))))


def _dealt(active: DataFrame, within: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of all buckets with their ``part``, and links with the middles of hot ones."""
    plain = ["bucket", F.lit(0).cast("long").alias("part"), "key", *_PRINT]
    large = active.filter(F.col("n") > hot)
    if large.isEmpty():
        return active.select(*plain), None
    bits = [F.sum(F.getbit("f0", F.lit(b)).cast("long")).alias(f"b{b}") for b in range(64)]
    majority = sum((F.shiftleft((2 * F.col(f"b{b}") > F.col("n")).cast("long"), b) for b in range(1, 64)), (2 * F.col("b0") > F.col("n")).cast("long"))
    middle = large.groupBy("bucket", "n").agg(*bits).select("bucket", majority.alias("m"))
    near = F.struct(F.bit_count(F.col("f0").bitwiseXOR(F.col("m"))).alias("d"), "key", *_PRINT)
    middle = large.join(to_every_task(middle, "majorities", MOST_BROADCAST), "bucket").groupBy("bucket").agg(F.min(near).alias("middle"))
    middle = middle.select("bucket", F.col("middle.key").alias("mkey"), *[F.col(f"middle.{f}").alias(f"m{f}") for f in _PRINT])
    told = materialise(large.join(to_every_task(middle, "middles", MOST_BROADCAST), "bucket").withColumn("near", _distance("", "m") <= within), "hot-buckets")
    parts = F.ceil(F.col("n") / hot)
    part = F.when(F.col("near"), F.array(F.pmod(F.xxhash64("key"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    spread = told.select("bucket", F.explode(part).alias("part"), "key", *_PRINT)
    star = told.filter("near and key <> mkey").select(F.col("key").alias("u"), F.col("mkey").alias("v"))
    return active.filter(F.col("n") <= hot).select(*plain).unionByName(spread), star


def groups(made: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc, body, least_doc, least_body): each text of a group of several, and the least of the group."""
    partitions, within = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), radius(threshold)
    first = F.min(F.struct("doc", "body")).alias("first")
    classes = materialise(made.groupBy("key").agg(first, F.max(F.struct("doc", "body")).alias("last"), F.first("bands").alias("bands"), *[F.first(f).alias(f) for f in _PRINT]), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "key", *_PRINT)
    sizes = to_every_task(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets", MOST_BROADCAST)
    active = materialise(members.join(sizes, "bucket"), "met")
    rows, star = _dealt(active, within, hot)
    sorted_rows = rows.repartition(partitions, "bucket", "part").sortWithinPartitions("bucket", "part")
    links = map_arrow(sorted_rows, _bucket_links(within), "u long, v long").distinct()
    roots = materialise(components(links.unionByName(star) if star is not None else links), "components")
    own = classes.select("key", "first")
    joined = own.join(to_every_task(roots.withColumnRenamed("vertex", "key"), "linked", MOST_BROADCAST), "key")
    least = to_every_task(joined.groupBy("root").agg(F.min("first").alias("least")), "leasts", MOST_BROADCAST)
    named = joined.join(least, "root").select("key", "least")
    alone = classes.filter("first <> last").join(named.select("key"), "key", "left_anti")
    named = named.unionByName(alone.select("key", F.col("first").alias("least")))
    return made.join(to_every_task(named, "named", MOST_BROADCAST), "key").select("doc", "body", F.col("least.doc").alias("least_doc"), F.col("least.body").alias("least_body"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One document of each group, with the columns as they are."""
    known = [F.col("doc").alias("_copy_doc"), F.col("body").alias("_copy_body")]
    made = materialise(sketches(docs, shingle), "sketches")
    dropped = groups(made, threshold, hot).filter("doc <> least_doc or body <> least_body").select(*known).distinct()
    again = made.groupBy("doc", "body").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*known)
    doc, body = _named(docs)
    same = (doc == F.col("_copy_doc")) & (body == F.col("_copy_body"))
    left = docs.join(to_every_task(dropped, "dropped", MOST_BROADCAST), same, "left_anti")
    again = to_every_task(again, "repeated", MOST_BROADCAST)
    if again.isEmpty():
        return left
    # Only rows whose id and text occur more than once are grouped.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = left.join(again, same, "left_semi").groupBy(doc.alias("_doc"), body.alias("_body")).agg(F.any_value(row).alias("_row")).select("_row.*")
    return left.join(again, same, "left_anti").unionAll(repeated)
