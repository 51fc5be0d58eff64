"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from placewright.llm import decontaminate, divergence, katz, langid, line_dedup, merkle, ngram_join, pieces, quality, recompression, secrets, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LABELS = "doc_id long, quality int, toxic int"


def rows(df):
    return df.collect()


def network():
    rng = np.random.default_rng(0)
    return secrets.train(rng.integers(0, 99, (40, secrets.WIDTH)), (np.arange(40) % 2).astype(float))


def toxic(spark, docs):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (None, 1, 1), (5, 1, 0), (7, 1, None)], LABELS)
    return toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, labels, toxicity.learned_from())))


def trees():
    return langid.Trees({"de": [b"der hund und die katze"], "en": [b"the cat and the dog"]})


OPERATORS = {
    "katz": lambda s, d: katz.katz_scores(d, F.col("doc_id") % 2 == 1),
    "sentencepiece": lambda s, d: pieces.encode(d, MODEL),
    "language": lambda s, d: langid.identify(d, trees()),
    "tokens": lambda s, d: token_counts.token_counts(d, WORDS),
    "toxicity": toxic,
    "quality": lambda s, d: quality.quality_rules(d),
    "lines": lambda s, d: line_dedup.line_dedup(d),
    "secrets": lambda s, d: secrets.find_secrets(d, network()),
    "join": lambda s, d: ngram_join.ngram_join(d),
    "manifest": lambda s, d: merkle.merkle_manifest(d.withColumn("n_chars", F.length("text"))),
    "substrings": lambda s, d: recompression.substring_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, edge, name):
    got = rows(OPERATORS[name](spark, edge))
    assert len(got) == edge.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in edge.collect())
    twice = [r for r in got if r["doc_id"] == 3]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, edge, name):
    assert rows(OPERATORS[name](spark, edge.limit(0))) == []


def test_defined_results(spark, edge):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    lang, tok, seg = by(langid.identify(edge, trees())), by(token_counts.token_counts(edge, WORDS)), by(pieces.encode(edge, MODEL))
    for i in (1, 2, 6):
        assert (lang[i]["lang_pred"], lang[i]["score"], tok[i]["n_tokens"]) == ("und", 0.0, 0)
    assert seg[1]["ids"] == [] and seg[1]["score"] == 0 and all(r["round_trip"] for r in seg.values())
    assert tok[5]["over_limit"] and tok[5]["n_tokens"] == 30_000
    q = by(quality.quality_rules(edge))
    assert q[1]["n_words"] == 0 and q[1]["base_failed"] and q[5]["n_repeat_words"] == 30_000 and q[3]["source"] == "a"
    j = by(ngram_join.ngram_join(edge))
    assert j[4]["class_id"] == 3 and j[3]["n_copies"] == 2 and j[1]["class_id"] == 1 and j[2]["n_copies"] == 0
    k = by(katz.katz_scores(edge, F.col("doc_id") % 2 == 1))
    assert k[1]["n_tokens"] == 1 and k[5]["n_tokens"] == 30_001 and not k[None]["held_out"]
    cut = by(line_dedup.line_dedup(edge, copy_percent=200))
    assert cut[4]["text"] == "" and cut[3]["text"].startswith("the cat") and cut[1]["text"] is None


def test_filters_keep_columns_and_clean_rows(spark, edge):
    one = ngram_join.one_of_each(edge)
    assert one.columns == edge.columns and sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
    items = spark.createDataFrame([(1, "the cat sat on the mat today"), (2, None), (3, "")], "item_id long, text string")
    left = decontaminate.without_benchmark(edge, items)
    assert left.columns == edge.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "5", "6", "7", "None"]
    assert decontaminate.decontaminate(edge, items.limit(0)).count() == 0 and decontaminate.decontaminate(edge.limit(0), items).count() == 0
    labels = spark.createDataFrame([], LABELS)
    assert toxicity.not_toxic(edge, labels, toxicity.learned_from()).columns == edge.columns


def test_divergence_of_odd_rows(spark, edge):
    """Null languages and sources are empty ones; groups without a kept term take part; an empty table gives none."""
    got = rows(divergence.divergence(edge))
    groups = {(r["lang"] or "", r["source"] or "") for r in edge.collect()}
    assert {(r["lang"], r["source"]) for r in got if r["part"] == "pair"} == {g for g in groups if any(h[0] == g[0] and h != g for h in groups)}
    assert rows(divergence.divergence(edge.limit(0))) == []
    twice = spark.createDataFrame([("x x y", "en", "a"), ("x y", "en", "a"), ("x", "en", "b"), (None, "fr", "c"), ("", "fr", "d")], "text string, lang string, source string")
    found = {(r["source"], r["part"], r["item"]): r["value"] for r in rows(divergence.divergence(twice))}
    assert found == {("a", "pair", "b"): 0, ("b", "pair", "a"): 0, ("c", "pair", "d"): 0, ("d", "pair", "c"): 0}


def test_manifest_of_odd_rows(spark, edge):
    full = edge.withColumn("n_chars", F.length("text"))
    got = rows(merkle.merkle_manifest(full, {"text": merkle.lower_ascii(F.col("text"))}))
    assert len({r["root"] for r in got}) == 1 and len({(r["source"], r["subroot"]) for r in got}) == 3
    assert all(r["verified"] for r in got)  # no text has A-Z
    longer = rows(merkle.merkle_manifest(full, {"text": F.concat("text", F.lit("!"))}))
    assert [r["doc_id"] for r in longer if r["verified"]] == [1] and [r["leaf"] for r in longer] == [r["leaf"] for r in got]
    alone = rows(merkle.merkle_manifest(full.where("doc_id = 2")))[0]
    assert alone["leaf"] == alone["subroot"] == alone["root"] == alone["folded_root"]


def test_substrings_of_odd_rows(spark):
    words = [f"w{i}" for i in range(40)]
    run = lambda *w: " ".join(w)
    data = [
        (3, run(*words[:20]), "k"), (3, run(*words[:20]), "k"), (1, run("a", *words[:12]), "k"), (5, run("x", *words[4:17], "y\n z"), "k"), (None, run(*words[27:]), "k"), (6, run(*words[26:], "e"), "k"),
        (7, " ".join(["q"] * 500), "k"), (8, " ".join(["q"] * 20), "k"), (9, "short text", "k"), (10, "short text", "k"), (11, None, "k"), (12, "", "k"),
    ]
    got = {(r["doc_id"], r["n_words"]): r for r in rows(recompression.substring_dedup(spark.createDataFrame(data, "doc_id long, text string, kept string")))}
    cut = {k: r["n_removed"] for k, r in got.items()}
    assert cut == {(3, 20): 0, (1, 13): 0, (5, 16): 13, (None, 13): 0, (6, 15): 13, (7, 500): 0, (8, 20): 20, (9, 2): 0, (10, 2): 0, (11, 0): 0, (12, 0): 0}
    assert got[5, 16]["kept"] == "x y z" and got[5, 16]["removed"] == [(1, 14)] and got[6, 15]["kept"] == "w26 e" and got[8, 20]["kept"] == ""
