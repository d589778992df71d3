"""Quality classifier: perplexity under interpolated Kneser-Ney models.

A model is a modified Kneser-Ney model of order four over characters as they are
written (white space is one space, a line end stays one). There is one for each
language with enough trusted documents, and one over all languages for the rest.
They are trained on three quarters of the whole texts that are labelled good.
Counts are added up inside each partition and then by n-gram; contexts,
continuation counts and backoff weights are grouped from them and joined by
context, so what is gathered grows with the corpus and is never in one place.

A document's perplexity comes from joining the counts of its distinct n-grams
with the tables of all orders; those of an n-gram's shorter ends matter only where
it was never seen itself. A table of at most ``MOST_BROADCAST_GRAMS`` rows is
sent to every task, so that documents stay where they are; a larger one is
sharded by n-gram, as are then the documents' counts. A document is kept if its
perplexity is at most a quantile of that of the trusted documents of its
language that were held out of the training, and at least another.

Toxic words hardly change a document's perplexity. So text that is labelled toxic
trains models in the same way, and a document's toxicity is how much likelier its
n-grams get, on average, if a small share of its characters came from there. It is
kept only if that is at most some times a quantile of the held-out trusted ones'.

Defined results
    null or empty text: no n-gram, perplexity null, not kept. Very long text:
    read whole; memory holds its distinct n-grams.
    null or unseen language, or one of fewer than ``LEAST_TRUSTED`` documents in
    training: the model and the quantiles over all languages.
    No trusted documents: no model; perplexity null, nothing is kept. None
    labelled toxic: toxicity 0.
    A perplexity at a quantile is kept. Empty table: no rows.
    null ``doc_id``: scored, never trusted. Repeated rows: scored alike.
    Only ``doc_id``, ``text`` and ``lang`` are read, so clashing columns cannot
    matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.functions.arrow import map_arrow
from rowcraft.llm.support import materialise, to_every_task

ORDER = 4
#: Quantiles of held-out trusted documents, and how far beyond them still passes.
LOW, HIGH, SLACK = 0.01, 0.95, 1.2
#: Share of a text's characters that toxic text may have, and how many times
#: likelier than in trusted text an n-gram must be there to count.
SHARE, LEAST_RATIO = 0.01, 4.0
#: Quantile of the toxicity of held-out trusted documents, and how many times as
#: much still passes.
TOXIC, TOXIC_SLACK = 0.95, 4.0
#: One in so many trusted documents is held out for the quantiles.
HELD_OUT = 4
#: A language of fewer documents in training has no model of its own.
LEAST_TRUSTED = 30
#: A discount is at least this, so that what was never seen is never impossible.
LEAST_DISCOUNT = 0.1
#: Rows of a table of n-grams, and trusted ids, that are sent to every task.
MOST_BROADCAST_GRAMS = 5_000_000
MOST_BROADCAST_IDS = 1_000_000
#: The same for the table of languages, so that a frequent language's documents
#: stay where they are.
MOST_BROADCAST_LANGUAGES = 10_000
#: Rows of n-grams that a task hands over at once.
_ASKED_ROWS = 200_000

#: The model over all languages.
ALL = "*"
#: Bits of a character in an n-gram; code points beyond them share places.
_BITS = 16
_MASK = (1 << _BITS) - 1


def grams(text: str) -> np.ndarray:
    """The n-grams of a whole text as longs, begun by line ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    blank = _BLANK[np.minimum(codes, len(_BLANK) - 1)]
    c = np.where(blank, np.uint64(32), codes.astype(np.uint64) & np.uint64(_MASK))
    if len(c):
        c = c[~(blank & np.concatenate(([False], blank[:-1])))]  # a run is one space
    c = np.concatenate((np.full(ORDER - 1, 10, np.uint64), c))
    made = np.zeros(len(c) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        made = (made << np.uint64(_BITS)) | c[k : k + len(made)]
    return made.view(np.int64)


_BLANK = np.array([chr(c).isspace() and c != 10 for c in range(0x3001)] + [False])


def _tail(gram: Column, order: int) -> Column:
    """The last characters of an n-gram."""
    return gram if order == ORDER else gram.bitwiseAND(F.lit((1 << (_BITS * order)) - 1))


def _context(gram: Column) -> Column:
    """All but the last character."""
    return F.shiftrightunsigned(gram, _BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, added up batch by batch."""
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(grams(text.as_py() or ""))
        for lang, found in by_lang.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(gram), np.int64))), pa.array(gram), pa.array(n)], ["model", "gram", "n"])


def _discounted(counts: DataFrame) -> DataFrame:
    """Adds ``rest`` = max(n - D(n), 0) / total and the context's ``gamma``; D by model."""
    by_size = counts.groupBy("model").agg(*[F.greatest(F.lit(1), F.count(F.when(F.col("n") == k, 1))).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.lit(float(k)), F.greatest(F.lit(LEAST_DISCOUNT), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).alias(f"d{k}") for k in (1, 2, 3)]
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # One row a model: as many as languages.
    given = counts.join(to_every_task(by_size.select("model", *d), "discounts", MOST_BROADCAST_LANGUAGES), "model").withColumn("d", discount).withColumn("context", _context(F.col("gram")))
    stats = given.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
    rest = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
    return given.join(stats, ["model", "context"]).select("model", "gram", "context", rest.alias("rest"), (F.col("taken") / F.col("total")).alias("gamma"))


class Model:
    """Tables (model, gram, context, p, gamma) of interpolated modified Kneser-Ney models, by order from 1."""

    def __init__(self, counts: DataFrame, names: list[str]):
        """``counts``: (model, gram, n)."""
        self.names = names
        parts: dict[int, DataFrame] = {}
        current = counts
        for order in range(ORDER, 0, -1):
            parts[order] = materialise(_discounted(current), f"order-{order}")
            lower = _tail(F.col("gram"), order - 1)
            current = current.groupBy("model", lower.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        unseen = F.first("gamma") / (F.count(F.lit(1)) + 1)
        self.unseen = to_every_task(parts[1].groupBy("model").agg(unseen.alias("unseen")), "unseen", MOST_BROADCAST_LANGUAGES)
        self.tables = {1: parts[1].join(self.unseen, "model").withColumn("p", F.col("rest") + F.col("unseen"))}
        for order in range(2, ORDER + 1):
            # The end of an n-gram that was seen was seen too.
            below = self.tables[order - 1].select("model", F.col("gram").alias("tail"), F.col("p").alias("below"))
            joined = parts[order].withColumn("tail", _tail(F.col("gram"), order - 1)).join(below, ["model", "tail"])
            made = joined.withColumn("p", F.col("rest") + F.col("gamma") * F.col("below"))
            self.tables[order] = materialise(made.select("model", "gram", "context", "p", "gamma"), f"p-{order}")


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("fold")), F.lit(HELD_OUT)) == 0


def trusted(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST_IDS) -> DataFrame:
    """Documents labelled good and not toxic."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(to_every_task(good, "trusted", most_broadcast), "doc_id", "left_semi")


def toxic_ones(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST_IDS) -> DataFrame:
    """Documents labelled toxic."""
    bad = labels.filter("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(to_every_task(bad, "toxic", most_broadcast), "doc_id", "left_semi")


def fit(docs: DataFrame, least_trusted: int = LEAST_TRUSTED) -> Model | None:
    """Models from rows (text, lang); None if there is no text."""
    known = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).alias("lang"))
    counted = map_arrow(known, _count, "model string, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "counts")
    if counted.isEmpty():
        return None
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least_trusted) & (F.col("lang") != ALL)).limit(MOST_BROADCAST_LANGUAGES).collect()}
    pooled = counted.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("model"), "gram", "n")
    names = sorted(sizes)
    return Model(counted.filter(F.col("model").isin(names)).unionByName(pooled) if names else pooled, names)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each row's text and how often each occurs.

    ``row`` tells rows apart that share a ``doc_id``. A row without text has
    one n-gram that occurs no time, so that it is not lost.
    """
    at, task = 0, TaskContext.get().partitionId() << 40
    for batch in batches:
        held, size = [], 0
        for k in range(batch.num_rows):
            found, times = np.unique(grams(batch.column(3)[k].as_py() or ""), return_counts=True)
            held.append((k, task + at, *((found, times) if len(found) else (np.array([0]), np.array([0])))))
            at, size = at + 1, size + max(1, len(found))
            if size >= _ASKED_ROWS or k == batch.num_rows - 1:
                source, row, found, times = zip(*held, strict=True)
                n = [len(c) for c in found]
                taken = pa.array(np.repeat(source, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(row, n)), *[batch.column(c).take(taken) for c in range(3)], pa.array(np.concatenate(found)), pa.array(np.concatenate(times))],
                    ["row", "doc_id", "lang", "model", "gram", "times"],
                )
                held, size = [], 0


def _key(model: str, gram: Column) -> Column:
    """What tables of n-grams are sharded and joined by."""
    return F.xxhash64(F.col(model), gram)


def _look_up(asked: DataFrame, table: DataFrame, key: Column, needed: Column, most_broadcast: int) -> DataFrame:
    """Joins a table of (_k, a value). If it is sent to every task, only rows that need it look."""
    found = materialise(table, "looked-up")
    small = found.count() <= most_broadcast
    return asked.withColumn("_k", F.when(needed, key) if small else key).join(F.broadcast(found) if small else found, "_k", "left").drop("_k")


def with_probability(asked: DataFrame, model: Model, most_broadcast: int = MOST_BROADCAST_GRAMS) -> DataFrame:
    """Adds ``p`` of each (model, gram), from the longest end of it that was seen."""
    gram, needed, columns = F.col("gram"), F.lit(True), asked.columns
    for order in range(ORDER, 0, -1):
        table, end = model.tables[order], _tail(gram, order)
        asked = _look_up(asked, table.select(_key("model", gram).alias("_k"), F.col("p").alias(f"p{order}")), _key("model", end), needed, most_broadcast)
        needed = needed & F.col(f"p{order}").isNull()
        if order > 1:
            gamma = table.groupBy("model", "context").agg(F.first("gamma").alias(f"gamma{order}")).select(_key("model", F.col("context")).alias("_k"), f"gamma{order}")
            asked = _look_up(asked, gamma, _key("model", _context(end)), needed, most_broadcast)
    asked = asked.join(model.unseen, "model")
    p = F.coalesce("p1", "unseen")
    for order in range(2, ORDER + 1):
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"gamma{order}"), F.lit(1.0)) * p)
    return asked.select(*columns, p.alias("p"))


def contrast(model: Model, toxic: Model, most_broadcast: int = MOST_BROADCAST_GRAMS) -> tuple[list[str], DataFrame]:
    """Names of the models that both have, and (_k, weight) of n-grams that toxic text has far more often.

    The weight is how much likelier an n-gram gets if ``SHARE`` of a text's
    characters come from the toxic model, as a logarithm.
    """
    names = sorted(set(model.names) & set(toxic.names))
    grams = toxic.tables[ORDER].filter(F.col("model").isin(ALL, *names)).select("model", "gram", F.col("p").alias("p_toxic"))
    ratio = F.col("p_toxic") / F.col("p")
    weight = F.log(1 - SHARE + SHARE * ratio)
    return names, with_probability(grams, model, most_broadcast).filter(ratio >= LEAST_RATIO).select(_key("model", F.col("gram")).alias("_k"), weight.alias("weight"))


def _model_of(names: list[str]) -> Column:
    return F.when(F.col("lang").isin(names), F.col("lang")).otherwise(F.lit(ALL)) if names else F.lit(ALL)


def score(docs: DataFrame, model: Model | None, most_broadcast: int = MOST_BROADCAST_GRAMS, toxic: Model | None = None) -> DataFrame:
    """doc_id, lang, n_grams, perplexity and toxicity of each whole text."""
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(lang as string) as lang", "text")
    if model is None:
        return narrow.select("doc_id", "lang", F.lit(0).cast("long").alias("n_grams"), *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "toxicity")])
    asked = map_arrow(narrow.select("doc_id", "lang", _model_of(model.names).alias("model"), "text"), _asked, "row long, doc_id long, lang string, model string, gram long, times long")
    told = with_probability(asked, model, most_broadcast)
    if toxic is None:
        told = told.withColumn("weight", F.lit(0.0))
    else:
        names, weights = contrast(model, toxic, most_broadcast)
        told = _look_up(told, weights, F.xxhash64(_model_of(names), F.col("gram")), F.lit(True), most_broadcast)
    cost, gain = F.sum(-F.log("p") * F.col("times")), F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("times"))
    sums = told.groupBy("row", "doc_id", "lang").agg(F.sum("times").alias("n_grams"), cost.alias("cost"), gain.alias("gain"))
    n = F.nullif(F.col("n_grams"), F.lit(0))
    return sums.select("doc_id", "lang", "n_grams", F.exp(F.col("cost") / n).alias("perplexity"), (F.col("gain") / n).alias("toxicity"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, least, most, toxicity, toxic_most and kept."""
    held = is_held_out(F.col("doc_id"))
    taught = docs.select("doc_id", "text", "lang").filter(~held)
    model, toxic = fit(trusted(taught, labels)), fit(toxic_ones(taught, labels))
    scored = materialise(score(docs, model, toxic=toxic), "perplexities")
    known = trusted(scored.filter(held), labels)
    found = F.array_append(F.percentile_approx("perplexity", [LOW, HIGH], 10_000), F.percentile_approx("toxicity", TOXIC, 10_000))
    names = model.names if model else []
    by_lang = known.filter(F.col("lang").isin(names)) if names else known.limit(0)
    by_lang = to_every_task(by_lang.groupBy(F.col("lang").alias("_lang")).agg(found.alias("ends")), "quantiles", MOST_BROADCAST_LANGUAGES)
    overall = known.agg(found.alias("all_ends"))
    joined = scored.join(by_lang, F.col("lang") == F.col("_lang"), "left").crossJoin(F.broadcast(overall))  # one row
    joined = joined.withColumn("ends", F.coalesce("ends", "all_ends"))
    least, most, toxic_most = F.col("ends")[0] / SLACK, F.col("ends")[1] * SLACK, F.col("ends")[2] * TOXIC_SLACK
    kept = F.coalesce(F.col("perplexity").between(least, most) & (F.col("toxicity") <= toxic_most), F.lit(False))
    return joined.select("doc_id", "lang", "n_grams", "perplexity", least.alias("least"), most.alias("most"), "toxicity", toxic_most.alias("toxic_most"), kept.alias("kept"))
