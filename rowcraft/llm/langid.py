"""Language identification: sparse multinomial logistic regression.

Features are character n-grams (one to three letters, words joined by one
space) hashed to ``DIM`` columns, weighted by TF-IDF and scaled to length one.
Document frequencies are counted over all training documents. The weights are
fitted with follow-the-regularised-leader, whose elastic net drives most of
them to exactly zero, on a bounded sample: at most about ``PER_LANGUAGE``
documents of each language, chosen by a hash, and ``SAMPLE`` of all. A fifth of
it is set aside to fit the temperature that calibrates the scores.

The model has ``DIM`` columns times the number of languages, whatever the size
of the corpus, and goes to the tasks with the function that uses it. Values of
``lang`` with fewer than ``LEAST_DOCUMENTS`` documents are not learned, and at
most ``MOST_LANGUAGES`` of the others are, the frequent ones first.

Defined results
    null text, or a text without a letter: ``und`` with score 0.
    null ``lang``: not trained on. null ``doc_id``: its text form is empty.
    No training documents at all: every prediction is ``und`` with score 0.
    Very long texts: read whole. Repeated rows: predicted alike. Equal scores:
    the language that comes first by code point. Empty table: no rows.
    Only ``doc_id``, ``text`` and, for training, ``lang`` are read, so clashing
    columns cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm.support import materialise

DIM_BITS = 14
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
PER_LANGUAGE = 2000
#: Documents of the sample over all languages; bounds of the languages learned.
SAMPLE = 20_000
LEAST_DOCUMENTS, MOST_LANGUAGES = 3, 256
EPOCHS = 3
#: Learning rate, its offset, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.01
UNKNOWN = "und"

#: Folds by the remainder of CRC-32 of the id's text; this one is held out.
FOLDS, HELD_OUT = 4, 2


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> np.ndarray | None:
    """Hashed n-grams of a whole text, repeats included; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint64)
    blank = ~letter
    codes = codes[~(blank & np.concatenate(([True], blank[:-1])))]
    codes = np.concatenate(([np.uint64(32)], codes[:-1] if codes[-1] == 32 else codes, [np.uint64(32)]))
    found, gram = [], np.zeros(len(codes), dtype=np.uint64)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n < 1:
            break
        gram = gram[:n] * np.uint64(0x100000001B3) + codes[order - 1 :][:n] + np.uint64(order)
        found.append((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS))
    return np.concatenate(found).astype(np.int64)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and TF-IDF weights of length one."""
    grams = ngrams(text)
    if grams is None:
        return None
    counts = np.bincount(grams, minlength=DIM)
    columns = np.flatnonzero(counts)
    weights = np.log1p(counts[columns]) * idf[columns]
    norm = np.sqrt(weights @ weights)
    return columns, weights / norm if norm else weights


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (DIM, languages)
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        made = features(text, self.idf) if text and self.languages else None
        if made is None:
            return UNKNOWN, 0.0
        p = softmax((made[1] @ self.weights[made[0]]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by follow-the-regularised-leader over (columns, values, label)."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(at) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrunk = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) <= L1, 0.0, shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            columns, values, label = rows[k]
            w = weights(columns)
            error = softmax(values @ w)
            error[label] -= 1.0
            gradient = values[:, None] * error[None, :]
            grown = n[columns] + gradient**2
            z[columns] += gradient - (np.sqrt(grown) - np.sqrt(n[columns])) / ALPHA * w
            n[columns] = grown
    return weights(slice(None))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its log."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by column and language of a partition; column -1: all."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            grams = ngrams(text.as_py() or "")
            if grams is not None:
                counts = seen.setdefault(lang, np.zeros(DIM + 1, dtype=np.int64))
                counts[np.unique(grams)] += 1
                counts[DIM] += 1
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "col", "n"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows of (text, lang), doc_id choosing the sample."""
    spark = labelled.sparkSession
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counted = materialise(map_arrow(known.select("text", "lang"), _frequencies, "lang string, col long, n long").groupBy("lang", "col").agg(F.sum("n").alias("n")), "document-frequencies")
    often = counted.filter((F.col("col") == DIM) & (F.col("n") >= LEAST_DOCUMENTS)).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in often.collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros(DIM), np.zeros((DIM, 0)), 1.0)
    per_language = min(per_language, SAMPLE // len(languages))
    frequency = np.zeros(DIM)
    for r in counted.filter(F.col("col") < DIM).groupBy("col").agg(F.sum("n").alias("n")).collect():
        frequency[r["col"]] = r["n"]
    every = counted.filter(F.col("col") == DIM).agg(F.sum("n")).first()[0]
    idf = np.log((1 + every) / (1 + frequency)) + 1
    share = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes.items()], "lang string, share double")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    # At most as many rows as languages are learned.
    sample = known.join(F.broadcast(share), "lang").filter(part < F.col("share")).select("doc_id", "text", "lang")
    label = {lang: k for k, lang in enumerate(languages)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            columns, values = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            ends = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            for k, (doc_id, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                part = slice(ends[k], ends[k + 1])
                rows.append((doc_id, columns[part].astype(np.int32), values[part].astype(np.float32), label[lang]))
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3], len(r[1]), r[1].tobytes()))
        made = [(c, v, k) for _, c, v, k in rows]
        tuned, trained = made[::5], [r for at, r in enumerate(made) if at % 5] or made
        weights = train(trained, len(languages))
        logits = np.array([v @ weights[c] for c, v, _ in tuned]).reshape(len(tuned), len(languages))
        heat = calibrate(logits, np.array([k for *_, k in tuned], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([heat])], ["weights", "temperature"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), idf) for t in batch.column(1)]
            keep = [k for k, m in enumerate(made) if m is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(2).take(pa.array(keep, pa.int64())), pa.array([made[k][0] for k in keep], pa.list_(pa.int32())), pa.array([made[k][1] for k in keep], pa.list_(pa.float32()))],
                ["doc_id", "lang", "columns", "values"],
            )

    # The sample is bounded, so one task may fit on all of it.
    encoded = map_arrow(sample.selectExpr("cast(doc_id as long) as doc_id", "text", "lang"), vectors, "doc_id long, lang string, columns array<int>, values array<float>")
    learnt = map_arrow(encoded.repartition(1), learn, "weights binary, temperature double").first()
    return Model(languages, idf, np.frombuffer(learnt["weights"]).reshape(DIM, len(languages)), learnt["temperature"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, "doc_id long, lang_pred string, score double")
