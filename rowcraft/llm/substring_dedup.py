"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the least hash of the
runs of ``mer`` words in it; consecutive windows that share it form a
super-k-mer. Equal windows have equal minimisers, so all copies of a window
meet in the bucket of their minimiser.

1.  Super-k-mers are listed without their words (minimiser, document, place).
    Minimisers found in one document only are done: nothing in them repeats
    elsewhere. This is a combinable minimum and maximum.
2.  The others travel as one packed string each to the bucket of their
    minimiser, where windows are sorted and compared word for word, and each
    gets the least document that has it.
3.  A bucket of more than half a partition's fair share of all packed strings is dealt
    to parts of that size. Each part sorts its windows in the same way; what it
    found is combined by window, and each part gets back the owners of its own
    windows. So a passage that a third of all documents share is spread evenly.
4.  Spans of removed words meet the documents once, by document.

Defined results
    null or empty text: no words. Very long text: read whole.
    null ``doc_id``: after every other document.
    Rows with one ``doc_id``: neither is the smaller, so they do not remove each
    other's words. Repeated rows: the same result each. Empty table: no rows.
    ``remove_repeats`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm.support import materialise, words

WINDOW = 50
MER = 8

#: A bucket is dealt to parts of half a partition's share; fewer packed strings
#: than this never make a part.
LEAST_PART = 32

#: Packed strings that a task holds before it passes them on.
_BATCH_BYTES = 4 << 20

#: Stands for a null ``doc_id``.
_LAST = (1 << 63) - 1

_PLACES = "minimiser long, doc long, text_key long, start int, n int"


def _minimisers(tokens: list[bytes], window: int, mer: int) -> np.ndarray:
    """The minimiser of every window of a document."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter(map(xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - mer + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(mer):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashes[k : k + n]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    width, have = window - mer + 1, 1
    while 2 * have <= width:
        rolled = np.minimum(rolled[:-have], rolled[have:])
        have *= 2
    if have < width:
        rolled = np.minimum(rolled[: len(rolled) - (width - have)], rolled[width - have :])
    return rolled.view(np.int64)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc`` and ``text_key``: what a row is known by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("body"), *columns
    )


def _places(docs: DataFrame, window: int, mer: int) -> DataFrame:
    """All super-k-mers, without their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text in enumerate(batch.column(2)):
                tokens = text.as_py().split()
                if len(tokens) >= window:
                    of = _minimisers(tokens, window, mer)
                    start = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1))
                    found.append((np.full(len(start), row), of[start], start, np.diff(np.concatenate((start, [len(of)])))))
            if found:
                row, least, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
                doc, key = (batch.column(k).to_numpy()[row] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least), pa.array(doc), pa.array(key), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["minimiser", "doc", "text_key", "start", "n"]
                )

    return map_arrow(_keyed(docs).withColumn("body", F.col("body").cast("binary")), run, _PLACES)


def _pieces(batch: pa.RecordBatch, window: int):
    """(document, key, pieces) of each row; a piece is (minimiser, part, start, words)."""
    for row in range(batch.num_rows):
        doc, key, text, places = (batch.column(k)[row].as_py() for k in range(4))
        tokens = text.split()
        yield doc, key, ((p["minimiser"], _part(doc, p["start"], p["parts"]), p["start"], tokens[p["start"] : p["start"] + p["n"] + window - 1]) for p in places)


def _part(doc: int, start: int, parts: int) -> int:
    """The part of a bucket that a super-k-mer goes to."""
    return ((doc * 0x9E3779B97F4A7C15 + start * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 33) % parts


def _pack(window: int):
    schema = pa.schema([("minimiser", pa.int64()), ("part", pa.int32()), ("doc", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("packed", pa.binary())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, key, pieces in _pieces(batch, window):
                for minimiser, part, start, tokens in pieces:
                    packed = b" ".join(tokens)
                    rows.append((minimiser, part, doc, key, start, packed))
                    held += len(packed)
                    if held > _BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return run, "minimiser long, part int, doc long, text_key long, start int, packed binary"


def _windows(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed super-k-mer, as slices of it."""
    text = np.frombuffer(packed, dtype=np.uint8)
    spaces = np.flatnonzero(text == 32)
    first = np.concatenate(([0], spaces + 1))
    end = np.concatenate((spaces, [len(text)]))
    return [packed[a:b] for a, b in zip(first[: len(end) - window + 1].tolist(), end[window - 1 :].tolist(), strict=True)]


def _distinct(rows: list[tuple], window: int) -> tuple[dict[bytes, list[bytes]], list[tuple[bytes, int, int]]]:
    """The windows of each packed string; and each distinct window, sorted, with
    the least and the greatest document that has it. Rows end (doc, ..., packed)."""
    ends: dict[bytes, tuple[int, int]] = {}
    for doc, *_, packed in rows:
        a, b = ends.get(packed, (doc, doc))
        ends[packed] = min(doc, a), max(doc, b)
    cut = {packed: _windows(packed, window) for packed in ends}
    found: list[tuple[bytes, int, int]] = []
    for words_, a, b in sorted((w, *ends[packed]) for packed in ends for w in cut[packed]):
        if found and found[-1][0] == words_:
            found[-1] = words_, min(a, found[-1][1]), max(b, found[-1][2])
        else:
            found.append((words_, a, b))
    return cut, found


def _lost(rows: list[tuple], owners: dict[bytes, np.ndarray], window: int, out: list[tuple]) -> None:
    """Adds the spans (doc, text_key, low, high) that rows lose to lesser owners."""
    for doc, key, start, packed in rows:
        lost = np.flatnonzero(owners[packed] < doc)
        if len(lost):
            gaps = np.flatnonzero(np.diff(lost) > 1)
            low = lost[np.concatenate(([0], gaps + 1))]
            high = lost[np.concatenate((gaps, [len(lost) - 1]))]
            out += [(doc, key, start + a, start + b + window) for a, b in zip(low.tolist(), high.tolist(), strict=True)]


_SPANS = pa.schema([("doc", pa.int64()), ("text_key", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
_FOUND = pa.schema([("minimiser", pa.int64()), ("part", pa.int32()), ("digest", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
_PACKED = ["minimiser", "part", "doc", "text_key", "start", "packed"]


def _digest(words_: bytes) -> bytes:
    return hashlib.sha256(words_).digest()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """((minimiser, part), rows) of batches that come sorted so."""
    bucket, rows = None, []
    for batch in batches:
        for minimiser, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (minimiser, part) != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = (minimiser, part), []
            rows.append(row)
    if rows:
        yield bucket, rows


def _batches(rows: Iterator[list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for found in rows:
        held += found
        if len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _whole_buckets(window: int):
    """Spans that the documents of whole buckets lose."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for _, rows in _by_bucket(batches):
            out: list[tuple] = []
            if len(rows) > 1:
                cut, found = _distinct(rows, window)
                owner = {words_: a for words_, a, _ in found}
                _lost(rows, {packed: np.array([owner[w] for w in ws]) for packed, ws in cut.items()}, window, out)
            yield out

    return lambda batches: _batches(spans(batches), _SPANS)


def _part_windows(window: int):
    """The distinct windows of each part, with the ends of their documents."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for bucket, rows in _by_bucket(batches):
            yield [(*bucket, _digest(words_), a, b) for words_, a, b in _distinct(rows, window)[1]]

    return lambda batches: _batches(windows(batches), _FOUND)


def _part_spans(window: int):
    """Spans that a part's documents lose; its owners are rows without a start."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for _, rows in _by_bucket(batches):
            owner = {packed: doc for doc, _, start, packed in rows if start is None}
            packed_rows = [row for row in rows if row[2] is not None]
            owners = {}
            for packed in {row[3] for row in packed_rows}:
                owners[packed] = np.array([owner.get(_digest(w), _LAST) for w in _windows(packed, window)])
            out: list[tuple] = []
            _lost(packed_rows, owners, window, out)
            yield out

    return lambda batches: _batches(spans(batches), _SPANS)


def _kept_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document to the runs that stay, as (from 1, length)."""
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32())]))
    for batch in batches:
        kept = []
        for spans in batch.column(2).to_pylist():
            runs, at = [], 0
            for span in sorted(spans, key=lambda s: s["low"]):
                if span["low"] > at:
                    runs.append({"first": at + 1, "length": span["low"] - at})
                at = max(at, span["high"])
            kept.append([*runs, {"first": at + 1, "length": (1 << 31) - 1 - at}])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, run_type)], ["doc", "text_key", "runs"])


def _dealt(packed: DataFrame) -> DataFrame:
    partitions = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(partitions, "minimiser", "part").sortWithinPartitions("minimiser", "part")


def kept_runs(docs: DataFrame, window: int = WINDOW, mer: int = MER, part_rows: int | None = None) -> DataFrame:
    """(doc, text_key, runs) of the documents that lose words.

    ``part_rows`` is the size above which a bucket is dealt to parts.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = materialise(_places(docs, window, mer), "super-k-mers")
    by_minimiser = places.groupBy("minimiser").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("rows"))
    # Written first, so that both sides of the join are plain exchanges, whose
    # large partitions Spark splits.
    shared = materialise(by_minimiser.filter("a < b").select("minimiser", "rows"), "shared-minimisers")
    if part_rows is None:
        part_rows = max(LEAST_PART, -(-(shared.agg(F.sum("rows")).first()[0] or 0) // (2 * partitions)))
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    listed = places.join(shared.select("minimiser", parts.alias("parts")), "minimiser").groupBy("doc", "text_key", (F.col("parts") > 1).alias("hot"))
    listed = materialise(listed.agg(F.collect_set(F.struct("minimiser", "start", "n", "parts")).alias("places")), "shared-super-k-mers")
    texts = _keyed(docs)
    run, schema = _pack(window)

    def packed(hot: bool) -> DataFrame:
        joined = texts.join(listed.filter(F.col("hot") == hot), ["doc", "text_key"])
        return map_arrow(joined.select("doc", "text_key", F.col("body").cast("binary").alias("body"), "places"), run, schema)

    span = "doc long, text_key long, low int, high int"
    spans = map_arrow(_dealt(packed(False)), _whole_buckets(window), span)
    if not listed.filter("hot").isEmpty():
        large = materialise(packed(True), "large-buckets")
        single = materialise(map_arrow(_dealt(large), _part_windows(window), "minimiser long, part int, digest binary, a long, b long"), "part-windows")
        first = single.groupBy("digest").agg(F.min("a").alias("doc"), F.max("b").alias("last"))
        first = materialise(first.filter("doc < last").drop("last"), "first-windows")
        owners = single.select("minimiser", "part", "digest").join(first, "digest")
        owners = owners.select("minimiser", "part", "doc", F.lit(0).cast("long").alias("text_key"), F.lit(None).cast("int").alias("start"), F.col("digest").alias("packed"))
        spans = spans.unionByName(map_arrow(_dealt(large.select(*_PACKED).unionByName(owners)), _part_spans(window), span))
    by_document = spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    return map_arrow(by_document, _kept_runs, "doc long, text_key long, runs array<struct<first:int,length:int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, part_rows: int | None = None) -> DataFrame:
    """``_row`` (the input's row), n_words, n_removed and the kept words."""
    runs = kept_runs(docs, window, mer, part_rows)
    if docs.columns == ["doc_id", "text"]:
        # The same exchange of texts as in ``kept_runs``, so Spark reuses it.
        whole, text = _keyed(docs), F.col("body")
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
        whole, text = _keyed(docs, row).drop("body"), F.col("_row.text")
    joined = whole.join(runs, ["doc", "text_key"], "left").withColumn("_words", words(text))
    left = F.flatten(F.transform("runs", lambda r: F.slice("_words", r["first"], r["length"])))
    joined = joined.withColumn("_kept", F.when(F.col("runs").isNull(), F.col("_words")).otherwise(left))
    if "_row" not in joined.columns:
        known = F.when(F.col("doc") == _LAST, F.lit(None)).otherwise(F.col("doc"))
        joined = joined.withColumn("_row", F.struct(known.alias("doc_id"), F.col("body").alias("text")))
    n = F.size("_words").cast("long")
    return joined.select("_row", n.alias("n_words"), (n - F.size("_kept")).alias("n_removed"), F.array_join("_kept", " ").alias("kept"))


def without_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """The documents with their repeated words taken out of ``text``.

    A text that loses nothing stays as it is; ``n_chars`` follows the text.
    """
    done = remove_repeats(docs, window, mer).withColumn("_text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_row.text")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])
