"""Operator 7, line de-duplication by a log-template tree; DataFrame functions only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens, where a token with a
digit counts as a field. Lines that meet in a leaf are generalised together: at each place a token that two or more
distinct lines of the leaf share stays, any other becomes a field, and so does every token with a digit. The result is
the line's template. A template that occurs in two or more documents recurs, if enough of it is fixed; its lines are
dropped from all documents but the first one. Only a copy is left as it is, for near-duplicate detection to judge as a
whole: a document nearly all of whose words recur from one single other document that is itself about as long.

Lines are extracted once and written with their masked text. All that is compared after that are numbers, so that
aggregates hash; which documents have a template is kept as the least and the greatest of them: two differ exactly if
there are two. The text of one line of each kind is fetched by its own place, and tables that meet under a key that may
be hot are written before, so that adaptive execution can split that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import OWN, SPACE_CLASS, row_key, written

#: Leading tokens that lead down the tree.
LEADING = 3
#: Lines of fewer tokens stay: they recur by chance.
MIN_TOKENS = 5
#: Share of a template's places that must be fixed.
FIXED = 0.6
#: Percent of a document's words that must recur from one other document for it to count as that one's copy, and the
#: least length of the shorter of the two in percent of the longer.
COPY_PERCENT = 80
#: What stands for a field.
_FIELD = "\x01"
_SPACE = SPACE_CLASS[1:-1]


def lines_of(docs: DataFrame, text: Column, row: Column, doc: Column, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """row, doc, no, n, masked, leaf, line, at for each line with enough tokens.

    row: the document's row key; doc: what orders documents; masked: the tokens, parted by single blanks; at: the place.
    A text is masked as a whole before it is split, so there is no step for each line or token that needs a pattern.
    """
    digits = F.regexp_replace(text, f"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+", _FIELD)
    masked = F.when(text.rlike("[0-9]"), digits).otherwise(text)
    plain = docs.select(row.alias("row"), doc.alias("doc"), masked.alias("m"))
    odd = "\t\x0b\x0c\r"
    blanks = F.when(F.col("m").rlike(f"[{odd}]"), F.translate("m", odd, "    ")).otherwise(F.col("m"))
    lines = plain.select("row", "doc", F.posexplode(F.split(blanks, "\n")).alias("no", "s"))
    single = F.when(F.col("s").contains("  "), F.regexp_replace("s", " {2,}", " ")).otherwise(F.col("s"))
    lines = lines.select("row", "doc", "no", F.trim(single).alias("masked"))
    lines = lines.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    leaf = F.xxhash64("n", F.substring_index("masked", " ", LEADING))
    return lines.where((F.col("n") >= min_tokens) & (F.col("masked") != "")).withColumns({"leaf": leaf, "line": F.xxhash64("masked"), "at": F.xxhash64("row", "no")})


def recurring(lines: DataFrame) -> DataFrame:
    """leaf, line -> first: for every distinct line whose template occurs in two documents or more, the least of them.

    lines: what lines_of gives, as a table. Only in leaves with several distinct lines and documents are tokens compared,
    as (place, token) rows, so no leaf, however full, is gathered in one row or task.
    """
    span = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    ends = [F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("at").alias("at")]
    distinct = written(lines.groupBy("leaf", "line").agg(*ends), "lines")
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("lines"), *span)
    several = written(leaves.where("lines > 1 and lo <> hi").select("leaf"), "leaves")
    chosen = distinct.join(several, "leaf", "left_semi")
    shared = written(lines.select("leaf", "line", "at", "n", "masked").join(chosen, ["leaf", "line", "at"]).drop("at"), "tokens")
    places = shared.select("leaf", "line", F.posexplode(F.split("masked", " ")).alias("no", "tok")).where(F.col("tok") != _FIELD)
    places = places.select("leaf", "line", F.xxhash64("no", "tok").alias("place"))
    often = written(places.groupBy("leaf", "place").agg(F.count("*").alias("n")).where("n > 1").select("leaf", "place"), "places")
    fixed = places.join(often, ["leaf", "place"]).groupBy("leaf", "line").agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("place")).alias("template"))
    general = shared.join(fixed, ["leaf", "line"], "left").select(
        "leaf", "line", "lo", "hi", F.when(F.col("fixed") >= FIXED * F.col("n"), F.col("template")).otherwise(F.col("line")).alias("template")
    )
    alone = distinct.where("lo <> hi").join(several, "leaf", "left_anti").select("leaf", "line", "lo", "hi", F.col("line").alias("template"))
    every = written(general.unionByName(alone), "templates")
    again = written(every.groupBy("leaf", "template").agg(*span).where("lo <> hi").select("leaf", "template", F.col("lo").alias("first")), "recurring")
    return every.join(again, ["leaf", "template"]).select("leaf", "line", "first")


def cuts_of(lines: DataFrame, copy_percent: int) -> DataFrame:
    """doc, row -> n_recurring_words, cut: the numbers of the lines to drop, null in a copy."""
    totals = written(lines.groupBy("doc", "row").agg(F.sum("n").alias("total")), "totals")
    gone = lines.select("leaf", "line", "doc", "row", "no", "n").join(recurring(lines), ["leaf", "line"]).where("first <> doc")
    by = gone.groupBy("doc", "row", "first").agg(F.sum("n").alias("words"), F.collect_set("no").alias("nos"))
    by = written(by.join(totals, ["doc", "row"]), "cuts")
    lengths = totals.groupBy(F.col("doc").alias("first")).agg(F.max("total").alias("length"))
    near = F.expr(f"100 * total >= {copy_percent} * length and 100 * length >= {copy_percent} * total")
    copies = by.where(f"100 * words >= {copy_percent} * total").join(written(lengths, "lengths"), "first").where(near)
    copies = copies.select("doc", "row", F.lit(True).alias("copy"))
    cut = by.groupBy("doc", "row").agg(F.sum("words").alias("n_recurring_words"), F.flatten(F.collect_list("nos")).alias("cut"))
    return cut.join(copies, ["doc", "row"], "left").select("doc", "row", "n_recurring_words", F.when(F.col("copy").isNull(), F.col("cut")).alias("cut"))


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", copy_percent: int = COPY_PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """`docs` with the recurring lines taken out of `text`, plus n_lines, n_dropped and n_recurring_words.

    The first document of a template keeps its lines: that of the least id where ids are whole numbers, of the least row
    key where they aren't. Every row stays, even if all its lines recur. Null texts stay null and have no line. Rows of
    one whole-number id are one document; null ids are told apart by their text and come first. An empty table gives an
    empty result; input columns named as an added one are replaced, all others stay. A copy_percent over 100 spares no
    copy.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = row_key(F.col(key), body)
    doc = row
    if isinstance(docs.schema[key].dataType, IntegralType):
        doc = F.coalesce(F.col(key).cast("long"), F.shiftright(row, 2) - F.lit(1 << 62))
    lines = written(lines_of(docs, body, row, doc, min_tokens), "all-lines")
    cut = cuts_of(lines, copy_percent).select(F.struct("doc", "row").alias(f"{OWN}key"), "n_recurring_words", F.col("cut").alias(f"{OWN}cut"))
    keyed = docs.drop("n_lines", "n_dropped", "n_recurring_words").withColumn(f"{OWN}key", F.struct(doc.alias("doc"), row.alias("row")))
    out = keyed.join(cut, f"{OWN}key", "left").withColumn(f"{OWN}lines", F.split(F.col(text).cast("string"), "\n"))
    split, gone = F.col(f"{OWN}lines"), F.col(f"{OWN}cut")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i))
    return out.withColumns(
        {
            text: F.when(F.size(gone) > 0, F.array_join(stay, "\n")).otherwise(F.col(text)),
            "n_lines": F.greatest(F.coalesce(F.size(split), F.lit(0)), F.lit(0)).cast("long"),
            "n_dropped": F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long"),
            "n_recurring_words": F.coalesce("n_recurring_words", F.lit(0)).cast("long"),
        }
    ).drop(f"{OWN}key", f"{OWN}cut", f"{OWN}lines")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", "n_recurring_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def cleaned_sql(source: str = "documents") -> str:
    """DuckDB SQL of line_dedup over a table with unique doc_id: doc_id, text, n_lines, n_dropped, n_recurring_words."""
    return rf"""(WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {source} WHERE text IS NOT NULL),
 t AS (SELECT doc_id, no, list_transform(list_filter(regexp_split_to_array(s, '[ 	-
]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END) AS toks FROM l),
 lines AS (SELECT doc_id, no, toks, len(toks) AS n, toks[1:{LEADING}] AS ld FROM t WHERE len(toks) >= {MIN_TOKENS}),
 dist AS (SELECT n, ld, toks, min(doc_id) AS lo, max(doc_id) AS hi FROM lines GROUP BY ALL),
 sev AS (SELECT n, ld FROM dist GROUP BY ALL HAVING count(*) > 1 AND min(lo) <> max(hi)),
 pl AS (SELECT n, ld, toks, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM dist SEMI JOIN sev USING (n, ld)),
 pn AS (SELECT n, ld, toks, pos, tok, count(*) OVER (PARTITION BY n, ld, pos, tok) AS c FROM pl),
 tp AS (SELECT n, ld, toks, list(CASE WHEN c > 1 AND tok <> '' THEN tok ELSE '' END ORDER BY pos) AS template, count(*) FILTER (c > 1 AND tok <> '') AS fixed FROM pn GROUP BY n, ld, toks),
 ev AS (SELECT d.n, d.ld, d.toks, d.lo, d.hi, CASE WHEN tp.fixed >= {FIXED} * d.n THEN ['t', array_to_string(tp.template, ' ')] ELSE ['l', array_to_string(d.toks, ' ')] END AS template FROM dist d LEFT JOIN tp ON d.n = tp.n AND d.ld = tp.ld AND d.toks = tp.toks),
 ag AS (SELECT n, ld, template, min(lo) AS first FROM ev GROUP BY ALL HAVING min(lo) <> max(hi)),
 rec AS (SELECT ev.n, ev.ld, ev.toks, ag.first FROM ev JOIN ag ON ev.n = ag.n AND ev.ld = ag.ld AND ev.template = ag.template),
 f AS (SELECT l.doc_id, l.no, l.n, r.first FROM lines l JOIN rec r ON l.n = r.n AND l.ld = r.ld AND l.toks = r.toks WHERE r.first <> l.doc_id),
 tot AS (SELECT doc_id, sum(n) AS total FROM lines GROUP BY doc_id),
 by1 AS (SELECT doc_id, first, sum(n) AS w, list(no) AS nos FROM f GROUP BY ALL),
 cp AS (SELECT b.doc_id FROM by1 b JOIN tot ON b.doc_id = tot.doc_id JOIN tot o ON b.first = o.doc_id WHERE 100 * b.w >= {COPY_PERCENT} * tot.total AND 100 * tot.total >= {COPY_PERCENT} * o.total AND 100 * o.total >= {COPY_PERCENT} * tot.total),
 c AS (SELECT doc_id, sum(w)::BIGINT AS w, CASE WHEN doc_id IN (SELECT doc_id FROM cp) THEN [] ELSE flatten(list(nos)) END AS cut FROM by1 GROUP BY doc_id)
 SELECT d.* REPLACE (CASE WHEN coalesce(len(cut), 0) > 0 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(cut, i)), chr(10)) ELSE text END AS text),
  coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(cut), 0)::BIGINT AS n_dropped, coalesce(w, 0)::BIGINT AS n_recurring_words
 FROM {source} d LEFT JOIN c USING (doc_id))"""


ORACLE = f"SELECT doc_id, n_lines, n_dropped, n_recurring_words, sha256(coalesce(text, '')) AS text_sha256 FROM {cleaned_sql()}"
