"""Operator 6, quality rules: one threshold table compiled into one Spark projection; no user functions.

Words are `[^\\x20\\x09-\\x0D]+`. Every rule is a ratio or a count that is compared with a lower and an upper bound.
The table is data (`RULES`), the projection is built from it, so that adding a rule needs no code elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, SPACE_CLASS, SPACES

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is it that for with as on be at are by an was this from "
    "le la les de des et du un une en que qui pour par au dans est sur "
    "der die das und den von zu mit ist ein eine nicht im auf als dem des "
    "el los las y en por del para con una se al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """measure: a column of `measures`. A text fails below `least` or above `most`; a null measure passes."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Bounds after the base rule. Ratios are over words, lines or code points, as the measure says.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbol_word_ratio", None, 0.30),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("bullets", "bullet_line_ratio", None, 0.90),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.30),
    Rule("capitals", "upper_char_ratio", None, 0.50),
)


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios.

    n_repeat_words: the 3-word windows of a text are hashed, sorted with their places and compared with their
    neighbours; the places of windows found twice or more then cover min(3, gap to the next place) words each. All of it
    stays inside the row, so there is no shuffle. Null text counts as empty. Windows are compared by a 64-bit hash.
    """
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    df = docs.withColumns(
        {
            f"{OWN}t": t,
            f"{OWN}w": F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda w: w != ""),
            f"{OWN}l": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]")),
        }
    )
    df = df.withColumn(
        f"{OWN}s",
        F.when(
            F.size(f"{OWN}w") >= 3,
            F.array_sort(
                F.transform(
                    F.arrays_zip(
                        F.slice(f"{OWN}w", 1, F.size(f"{OWN}w") - 2).alias("a"),
                        F.slice(f"{OWN}w", 2, F.size(f"{OWN}w") - 2).alias("b"),
                        F.slice(f"{OWN}w", 3, F.size(f"{OWN}w") - 2).alias("c"),
                    ),
                    lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")),
                )
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = lambda x, j: x["h"] == F.get(f"{OWN}s", j)["h"]
    df = df.withColumn(
        f"{OWN}d",
        F.array_sort(
            F.transform(
                F.filter(
                    f"{OWN}s",
                    lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.transform(f"{OWN}d", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(f"{OWN}d", k + 1) - x, F.lit(3))))
    n = F.size(f"{OWN}w").cast("long")
    lines = F.greatest(F.size(f"{OWN}l"), F.lit(1))
    words = F.greatest(n, F.lit(1))
    return df.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.translate(f"{OWN}t", SPACES.decode(), "")).cast("long"),
            "n_symbols": _count_chars(F.col(f"{OWN}t"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(f"{OWN}l") - F.size(F.array_distinct(f"{OWN}l"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
            f"{OWN}stop": F.size(F.filter(f"{OWN}w", lambda w: F.lower(w).isin(STOP_WORDS))),
        }
    ).withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_word_ratio": F.size(F.filter(f"{OWN}w", lambda w: w.rlike(r"^[#*$%&|<>]+$"))) / words,
            "stop_word_ratio": F.col(f"{OWN}stop") / words,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
            "bullet_line_ratio": F.size(F.filter(f"{OWN}l", lambda x: x.rlike(r"^\s*[-*•]"))) / lines,
            "ellipsis_line_ratio": F.size(F.filter(f"{OWN}l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) / lines,
            "upper_char_ratio": F.length(F.regexp_replace(f"{OWN}t", r"[^A-Z]", ""))
            / F.greatest(F.col("word_chars"), F.lit(1)),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the failed rules, as an array in the order of the table."""
    bad = []
    for r in rules:
        v = F.col(r.measure)
        out = F.lit(False)
        if r.least is not None:
            out = out | (v < r.least)
        if r.most is not None:
            out = out | (v > r.most)
        bad.append(F.when(F.coalesce(out, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*bad))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every column of `docs` but those that clash, plus the measures, `failed_rules`, `base_failed` and `kept`.

    Null and empty texts have no words: they fail the base rule. Rows are judged one by one, so repeated rows repeat in
    the result; an empty table gives an empty result; columns of the input that clash with a measure are replaced.
    """
    df = measures(docs, text)
    return df.withColumns({"failed_rules": compiled(rules), "base_failed": base_failed()}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    ).drop(f"{OWN}t", f"{OWN}w", f"{OWN}l", f"{OWN}s", f"{OWN}d", f"{OWN}stop")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
 pos AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
 win AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p AS g FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
 gap AS (SELECT doc_id, sum(least(3, coalesce(lead_i - i, 3))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead_i FROM dup) GROUP BY doc_id),
 m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r, 0)::BIGINT AS n_repeat_words, greatest(len(l), 1) AS nl, greatest(len(w), 1) AS nw,
        len(list_filter(w, lambda x: regexp_matches(x, '^[#*$%&|<>]+$'))) AS sw,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS st,
        len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bl, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS el,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up
       FROM w LEFT JOIN gap ON w.doc_id = gap.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / nw BETWEEN 2 AND 20 AND sw / nw <= 0.3 AND st / nw >= 0.02
   AND n_dup_lines / nl <= 0.5 AND bl / nl <= 0.9 AND el / nl <= 0.3 AND up / greatest(word_chars, 1) <= 0.5 AS kept
FROM m"""


ORACLE = _oracle()
