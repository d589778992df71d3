"""The queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcraft.llm import html_extract, langid, mixing, packing, perplexity, quality_rules, sharding, simhash, spotsigs, substring_dedup
from rowcraft.llm.quality_rules import STOP_WORDS
from rowcraft.llm.support import table

Query = Callable[[SparkSession, str], DataFrame]

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("_row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


_OP1_SQL = f"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln
           FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, len(ln) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains({list(dict.fromkeys(STOP_WORDS))!r}, lower(x)))) AS stops
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.1
       AND stops / n_words >= 0.03 AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5
       AND n_repeat_words / n_words <= 0.5 AS kept
FROM b
"""

_OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
own AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
lost AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN own USING (g), range(0, 50) r(k) WHERE m < doc_id),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
              FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                  ('0x' || substr(md5('{mixing.SEED}' || chr(31) || coalesce(doc_id::VARCHAR, 'null') || chr(31) || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT (total - spent)::DOUBLE / rest::DOUBLE AS level FROM c
      WHERE (total - spent)::DOUBLE / rest::DOUBLE * weight <= cap ORDER BY cap / weight, level LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM l), 0.0::DOUBLE) * weight, cap::DOUBLE) AS target FROM c),
r AS (SELECT d.doc_id, d.size, d.u, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM r
"""


def queries() -> dict[str, Query]:
    return {"op1_quality_rules": op1_quality_rules, "op2_sharding": op2_sharding, "op3_packing": op3_packing, "op4_substring_dedup": op4_substring_dedup, "op5_mixing": op5_mixing, "op6_simhash": op6_simhash, "op7_perplexity": op7_perplexity, "op8_html_extraction": op8_html_extraction, "op9_spotsigs": op9_spotsigs, "op10_language_id": op10_language_id}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1_SQL, "op4_substring_dedup": _OP4_SQL, "op5_mixing": _OP5_SQL}
