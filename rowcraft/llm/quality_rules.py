"""Quality rules: a threshold table compiled into one projection.

Every measure of a document is a built-in Spark expression over the whole
text, so the operator is a narrow projection: no shuffle, no Python.

Defined results
    null or blank text: all counts 0, ``base_failed`` true, not kept.
    null ``doc_id`` and repeated rows: each row is judged on its own.
    Empty table: no rows. A measure at its threshold passes. Very long texts: read
    whole; windows are told apart in texts of up to 2^28 words.
    Columns of the input whose names clash with a measure's are replaced in
    ``measure``; ``keep_good`` returns the input's own columns only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcraft.llm.support import WORD, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are at from or an this which not have his he they but "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les de et des en un une du que est pour dans qui par sur pas plus au ne se ce il avec son sont "
    "el los las y del que una por con para su al lo como más o pero sus le ya este sí porque"
).split()

#: The characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [least, most]; either may be open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The thresholds in use. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.5),
)

MIN_WORDS = 50

#: Bits of a sort key that hold a window's position; the rest hold its hash.
_POSITION_BITS = 28


def _repeat_words(tokens: Column) -> tuple[Column, int, Callable[[Column], Column]]:
    """Sorted keys of 3-word windows, the mask of their places, and their text.

    Windows are hashed and sorted as longs (hash above, position below), so
    equal windows are neighbours. The few positions whose hash repeats are
    then compared as text, which makes the count exact.
    """
    last = F.size(tokens) - F.lit(3)
    at = lambda i: F.xxhash64(tokens[i], tokens[i + 1], tokens[i + 2])
    text = lambda i: F.concat_ws(" ", tokens[i], tokens[i + 1], tokens[i + 2])
    places = F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    mask = (1 << _POSITION_BITS) - 1
    keys = F.sort_array(F.transform(places, lambda i: F.shiftleft(F.shiftrightunsigned(at(i), 1 + _POSITION_BITS), _POSITION_BITS).bitwiseOR(i.cast("long"))))
    return keys, mask, text


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures and ratios of each whole text."""
    clean = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(clean, "\n", -1), lambda x: x.rlike(WORD))
    counted = docs.withColumns({"_words": words(F.col("text")), "_lines": lines})
    tokens = F.col("_words")
    keys, mask, text = _repeat_words(tokens)
    counted = counted.withColumn("_keys", keys)
    prefix = lambda x: F.shiftright(x, _POSITION_BITS)
    # A key whose hash equals a neighbour's: its window may repeat.
    maybe = F.filter(
        F.col("_keys"),
        lambda k, j: (prefix(k) == prefix(F.get(F.col("_keys"), j - 1))) | (prefix(k) == prefix(F.get(F.col("_keys"), j + 1))),
    )
    counted = counted.withColumn("_maybe", F.transform(maybe, lambda k: k.bitwiseAND(F.lit(mask)).cast("int")))
    spelt = F.sort_array(F.transform(F.col("_maybe"), lambda i: F.struct(text(i).alias("w"), i.alias("i"))))
    counted = counted.withColumn("_spelt", spelt)
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    sure = F.filter(
        F.col("_spelt"),
        lambda x, j: same(x, F.get(F.col("_spelt"), j - 1)) | same(x, F.get(F.col("_spelt"), j + 1)),
    )
    counted = counted.withColumn("_starts", F.sort_array(F.transform(sure, lambda x: x["i"])))
    starts = F.col("_starts")
    # A window adds the words that reach beyond the window before it.
    covered = F.aggregate(
        F.transform(starts, lambda i, j: F.least(F.lit(3), F.coalesce(i - F.get(starts, j - 1), F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    n = F.size(tokens)
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    out = counted.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            "n_symbols": F.size(F.regexp_extract_all(clean, F.lit(SYMBOLS), F.lit(0))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "_stops": F.size(F.filter(tokens, lambda w: F.lower(w).isin(*STOP_WORDS))),
            "_n_lines": F.size("_lines"),
        }
    )
    return out.withColumns(
        {
            "mean_word_chars": per_word(F.col("word_chars")),
            "symbol_ratio": per_word(F.col("n_symbols")),
            "stop_word_ratio": per_word(F.col("_stops")),
            "dup_line_ratio": F.when(F.col("_n_lines") > 0, F.col("n_dup_lines") / F.col("_n_lines")).otherwise(0.0),
            "repeat_word_ratio": per_word(F.col("n_repeat_words")),
        }
    ).drop("_words", "_lines", "_keys", "_maybe", "_spelt", "_starts", "_stops", "_n_lines")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean expression that is true if every rule holds."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(rule.measure)
        if rule.least is not None:
            verdict = verdict & (value >= rule.least)
        if rule.most is not None:
            verdict = verdict & (value <= rule.most)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measure`` plus ``base_failed`` and ``kept``."""
    measured = measure(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    names = docs.columns
    # Judged beside the row, so that columns with clashing names survive.
    judged = judge(docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")), rules)
    # The filter reads a row number too, which keeps it above the projections:
    # pushed below, it would repeat every measure each time one is used.
    return judged.withColumn("_at", F.monotonically_increasing_id()).filter("kept and _at >= 0").select("_row.*")
