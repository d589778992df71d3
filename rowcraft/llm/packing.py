"""Packing: documents as token pieces in sequences of a fixed capacity.

Each partition packs its own documents, so nothing is shuffled and no task
needs more than one group of pieces in memory. A document is tokenised once;
every full ``capacity`` tokens become a sequence of their own, and the rest is
cut into pieces of at most ``piece`` tokens. A group of ``group`` pieces is
split by Karmarkar-Karp differencing into windows of near-equal sums; the
window count rises while one exceeds the capacity. Short pieces are what makes
the windows near-equal: at a quarter of the capacity padding is below 1 %.

Tokens come from the byte-level BPE vocabulary in its ``tiktoken`` form. Its
ids equal those of the ``tokenizers`` form of the same vocabulary (tested), at
a quarter of the CPU time. The vocabulary's end-of-text string becomes its
special id, as there. A text with a run of more than ``LONGEST_BLANK`` white-space
characters, on which the ``tiktoken`` form's pattern runs out of stack, takes its
ids from the ``tokenizers`` form, which needs time in proportion.

Defined results
    null or empty text: the document is its end id alone.
    null ``doc_id`` and repeated rows: packed like any other row.
    Very long texts, long runs of one character included: cut into sequences;
    memory holds one document's ids and one group. Equal lengths: first come,
    first served. Empty table: no rows.
    Only ``doc_id`` and ``text`` are read, so clashing columns cannot matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm.differencing import windows

CAPACITY = 2048
PIECE = 512
GROUP = 1024
END_ID = 1

#: Fixed values of the vocabulary: its special token, that token's id, and the
#: pattern that cuts a text before byte pairs are merged.
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space in a row that the pattern above is trusted with. Its look-ahead
#: keeps a state for each character, and the stack of the engine ends at a million.
LONGEST_BLANK = 20_000
_LONG_BLANK = re.compile(rf"\s{{{LONGEST_BLANK}}}")

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)

#: Sequence ids of a partition start at its number shifted by so many bits.
_SEQUENCE_BITS = 40


@cache
def _patient(vocabulary: str | None):
    """The ``tokenizers`` form; ``vocabulary`` is the path of its JSON file."""
    from tokenizers import Tokenizer

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(vocabulary)


@cache
def encoder(vocabulary: str | None = None, patient_vocabulary: str | None = None):
    """Text to ids; the paths are those of the two forms of the vocabulary."""
    import tiktoken

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    known = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})

    def encode(text: str) -> list[int]:
        if len(text) >= LONGEST_BLANK and _LONG_BLANK.search(text):
            return _patient(patient_vocabulary).encode(text, add_special_tokens=False).ids
        return known.encode(text, allowed_special="all") if SPECIAL in text else known.encode_ordinary(text)

    return encode


class _Packer:
    """The pieces of one partition on their way into sequences."""

    def __init__(self, first: int, capacity: int, piece: int, group: int):
        self.next, self.capacity, self.piece, self.group = first, capacity, piece, group
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._place([(doc_id, start, ids[start : start + self.capacity].tobytes(), total)])
        for start in range(full, total, self.piece):
            self.waiting.append((doc_id, start, ids[start : start + self.piece].tobytes(), total))
        while len(self.waiting) >= self.group:
            self._pack(self.group)

    def finish(self) -> None:
        self._pack(len(self.waiting))

    def _pack(self, n: int) -> None:
        batch, self.waiting = self.waiting[:n], self.waiting[n:]
        for members in windows([len(x[2]) // 4 for x in batch], self.capacity):
            self._place([batch[at] for at in members])

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def flush(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in _ARROW]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        self.rows = []
        return out


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, end_id: int = END_ID, vocabulary: str | None = None, patient_vocabulary: str | None = None) -> DataFrame:
    """One row a piece: its place in document and sequence, and its ids.

    ``ids`` are little-endian unsigned 32-bit integers, ready to be copied into
    a training shard. ``sequence_id`` is unique; ``offset`` is gapless in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, patient_vocabulary)
        packer = _Packer(TaskContext.get().partitionId() << _SEQUENCE_BITS, capacity, piece, group)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc_id, np.array(ids, dtype="<u4"))
                if len(packer.rows) >= 4096:
                    yield packer.flush()
        packer.finish()
        yield packer.flush()

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, SCHEMA)
