"""Operator 12, substring de-duplication by recompression.

A text is a string of words. Rounds replace runs of an equal symbol and then pairs of symbols (a, b), where a is of the
left and b of the right class, by names that depend on the parts alone. A symbol of any level has a range of words that
decides it; wherever the same words stand, the same symbols stand inside, whatever surrounds them. A window of 13 words
is revealed by one of the symbols that it so determines by itself: of the highest level that has one, the longest, so
that two equal windows in different texts point to the same symbol. Consecutive windows with one symbol are a segment.

Spark then names globally: per symbol the least and the greatest document that it reveals windows of. Only segments whose
symbol two documents share are looked at again; a whole text that recurs is one symbol and done with. Their windows are verified by names of 128 bits over all their words, and
those that a document with a smaller id has too are cut. What is exchanged is one row for every six words or so, not
one for each window, and windows only where a symbol recurs; common symbols are tables that adaptive joins split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import BYTE_TABLE, OWN, mix, range_hashes, row_key, steps, string_bytes, word_hashes, written

#: Words of a window.
WINDOW = 13
#: Rounds of pairs.
ROUNDS = 2

_U = np.uint64
_LEFT, _RIGHT, _COUNT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: Bits of a priority that hold the length of a symbol.
_LENGTH_SHIFT = _U(56)
_LEAST = -(2**63)


class Symbols:
    """One level: names, words [start, end), and the words [low, high) that decide that the symbol stands there."""

    def __init__(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> None:
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(self.name[at], self.start[at], self.end[at], self.low[at], self.high[at], self.doc[at])


def word_symbols(words: np.ndarray, first: np.ndarray) -> Symbols:
    """first: where the words of each text start, n + 1 values."""
    at = np.arange(len(words), dtype=np.int64)
    return Symbols(words, at, at + 1, at, at + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)))


def named_runs(s: Symbols) -> Symbols:
    """Each longest run of an equal symbol as one. Its neighbours decide where it ends; at an end of a text these are words
    outside, which no window of the text has."""
    if not len(s.name):
        return s
    new = np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(s.name)))
    end = s.end[head + size - 1]
    name = np.where(size > 1, mix(s.name[head] * _COUNT + size.astype(np.uint64)), s.name[head])
    return Symbols(name, s.start[head], end, s.start[head] - 1, end + 1, s.doc[head])


def named_pairs(s: Symbols, level: int) -> Symbols:
    """Each pair of a left and a right symbol as one. The class is a bit of the name, new at each level, so a pair is decided
    by itself; a symbol without a partner is decided by itself and the neighbour that it would have paired with."""
    if len(s.name) < 2:
        return s
    left = (mix(s.name ^ _U(level)) >> _U(63)).astype(bool)
    same = s.doc[1:] == s.doc[:-1]
    first = np.append(left[:-1] & ~left[1:] & same, False)
    second = np.concatenate([[False], first[:-1]])
    low, high = s.low.copy(), s.high.copy()
    next_too, before_too = np.flatnonzero(same & left[:-1]), np.flatnonzero(same & ~left[1:]) + 1
    high[next_too] = s.high[next_too + 1]
    low[before_too] = s.low[before_too - 1]
    head = np.flatnonzero(~second)
    out = s.take(head)
    out.low, out.high = low[head], high[head]
    pair = np.flatnonzero(first[head])
    a, b = head[pair], head[pair] + 1
    out.name = out.name.copy()
    out.name[pair] = mix(s.name[a] * _LEFT + s.name[b] * _RIGHT + _U(level))
    out.end[pair], out.low[pair], out.high[pair] = s.end[b], s.low[a], s.high[b]
    return out


def chosen(words: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window, by its first word: (starts of windows, names of their symbols, ids of the symbols' places).

    The name is that of the symbol and of the words that decide it, which the window holds too. A window takes the highest level of which it decides a symbol by itself, there the longest, and of these the one with the
    least scrambled name, the first of equal ones. Every window decides its own words, so each has one.
    """
    levels = [word_symbols(words, first)]
    levels.append(named_runs(levels[0]))
    for level in range(1, rounds + 1):
        levels.append(named_pairs(levels[-1], level))
    size = np.diff(first)
    n = np.maximum(size - window + 1, 0)
    begins = np.cumsum(n) - n
    start = np.arange(n.sum()) - np.repeat(begins, n) + np.repeat(first[:-1], n)
    name, place = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    todo = np.arange(len(start))
    base = 0
    for s in reversed(levels):
        lo, hi = np.searchsorted(s.low, start[todo]), np.searchsorted(s.high, start[todo] + window, side="right")
        some = hi > lo
        at, lo, hi = todo[some], lo[some], hi[some]
        length = np.minimum(s.end - s.start, 255).astype(np.uint64)
        rank = (length << _LENGTH_SHIFT) | (mix(s.name) >> _U(8))
        best, best_rank = lo.copy(), rank[lo]
        for k in range(1, int((hi - lo).max(initial=0))):
            more = np.flatnonzero(lo + k < hi)
            r = rank[lo[more] + k]
            better = more[r > best_rank[more]]
            best[better] = lo[better] + k
            best_rank[better] = rank[best[better]]
        name[at] = mix(s.name[best] + range_hashes(words, s.low[best], s.high[best]))
        place[at] = base + best
        base += len(s.name)
        todo = todo[~some]
        if not len(todo):
            break
    return start, name, place


def window_names(words: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two names of 64 bits each for the windows that begin at the words `start`."""
    a, b = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    other = mix(words + _COUNT)
    for k in range(window):
        a = a * _LEFT + words[start + k]
        b = mix(b + other[start + k])
    return mix(a), b


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*string_bytes(column), table=BYTE_TABLE)


def segments(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, doc, text -> key, doc, name, start, n: the n windows from the start-th on have the symbol `name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            words, first = _hashed(part.column("text"))
            start, name, place = chosen(words, first, window)
            if not len(start):
                continue
            doc = np.searchsorted(first, start, side="right") - 1
            head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(head, len(start))).astype(np.int32)
            row = doc[head]
            at = (start[head] - first[row]).astype(np.int32)
            own = [part.column(c).take(pa.array(row)) for c in ("key", "doc")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(name[head].view(np.int64)), pa.array(at), pa.array(n)], names=["key", "doc", "name", "start", "n"])

    return rows.select("key", "doc", "text").mapInArrow(run, f"key long, doc {rows.schema['doc'].dataType.simpleString()}, name long, start int, n int")


def shared_names(occurrences: DataFrame, names: list[str]) -> DataFrame:
    """Names that two documents or more have, with the least of these: `lo`."""
    return occurrences.groupBy(*names).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select(*names, "lo")


def windows_of(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, doc, text, spans (start, n) -> a, b, key, doc, start of each window in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            words, first = _hashed(part.column("text"))
            spans = part.column("spans")
            n_spans = np.diff(spans.offsets.to_numpy())
            begin, n = (spans.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            row = np.repeat(np.repeat(np.arange(part.num_rows), n_spans), n)
            start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = window_names(words, first[row] + start, window)
            own = [part.column(c).take(pa.array(row)) for c in ("key", "doc")]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *own, pa.array(start.astype(np.int32))], names=["a", "b", "key", "doc", "start"])

    return texts.mapInArrow(run, f"a long, b long, key long, doc {texts.schema['doc'].dataType.simpleString()}, start int")


def order_of(docs: DataFrame, key: str) -> Column:
    """What orders documents: their id; nulls come first and are one."""
    if isinstance(docs.schema[key].dataType, IntegralType):
        return F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    return F.coalesce(F.concat(F.lit("s"), F.col(key).cast("string")), F.lit(""))


def repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, starts, whole: for each row of `docs` that has some (by its row key) the places of the windows that a document
    with a smaller id has too, in words from 0; whole: all of them, as the whole text is that of such a document.

    A whole text is the highest symbol of all. A copy is done with that, and its words are looked for in the document with
    the least id that has it.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(row_key(F.col(key), body).alias("key"), order_of(docs, key).alias("doc"), body.alias("text"))
    rows = rows.withColumns({"x": F.xxhash64("text"), "y": F.xxhash64(F.lit(WINDOW), "text")})
    copied = written(shared_names(rows, ["x", "y"]), "copied")
    marked = rows.join(copied, ["x", "y"], "left")
    copies = rows.select("key", "doc", "x", "y").join(copied, ["x", "y"]).where("doc > lo").select("key").distinct()
    originals = marked.where("lo is null or doc <= lo").select("key", "doc", "text")
    occurring = written(segments(originals, window), "segments")
    shared = written(shared_names(occurring, ["name"]).select("name"), "shared")
    spans = occurring.select("key", "name", "start", "n").join(shared, "name").groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    found = written(windows_of(rows.select("key", "doc", "text").join(written(spans, "spans"), "key"), window), "windows")
    again = written(shared_names(found, ["a", "b"]), "repeated")
    later = found.join(again, ["a", "b"]).where("doc > lo")
    parts = later.groupBy("key").agg(F.collect_set("start").alias("starts")).withColumn("whole", F.lit(False))
    return parts.unionByName(copies.select("key", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with n_words, n_removed, kept, removed: `kept` are the words left, joined by single blanks, `removed` the runs
    of words taken out as (start, end) in words of the input.

    A word goes if a window of `window` words of its document that covers it also starts in a document with a smaller id.
    Windows are those of the input. Words are what stands between ASCII white space, compared as they are. Null texts have no
    word; texts shorter than a window lose none. Rows of equal ids never take from each other, so repeated rows stay alike;
    null ids come first and are one id. Repeats inside one document stay. An empty table gives an empty result; input
    columns named as an added one are replaced, all others stay.
    """
    added = ["n_words", "n_removed", "kept", "removed"]
    docs = docs.drop(*added)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cuts = written(repeats(docs, window, text, key), "cuts").select(*[F.col(c).alias(f"{OWN}{c}") for c in ("key", "starts", "whole")])
    keyed = docs.withColumn(f"{OWN}key", row_key(F.col(key), body)).join(cuts, f"{OWN}key", "left").drop(f"{OWN}key")
    columns = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text):
            n_words, n_removed, kept, removed = [], [], [], []
            for t, starts, whole in zip(part.column(text).cast(pa.string()).to_pylist(), part.column(f"{OWN}starts").to_pylist(), part.column(f"{OWN}whole").to_pylist()):
                words = (t or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if whole and len(words) >= window:
                    gone[0] = 1
                elif starts:
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.array(starts) + window, -1)
                cut = np.concatenate([[False], np.cumsum(gone)[:-1] > 0, [False]])
                edges = np.flatnonzero(cut[1:] != cut[:-1])
                n_words.append(len(words))
                n_removed.append(int(cut.sum()))
                removed.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
                kept.append(b" ".join(w for w, c in zip(words, cut[1:-1]) if not c) if cut.any() else b" ".join(words))
            own = [part.column(c) for c in columns]
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=[*columns, *added])

    return keyed.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 p AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM w WHERE len(words) >= {WINDOW}),
 g AS (SELECT p.doc_id, pos, list_slice(words, pos, pos + {WINDOW - 1}) AS gram FROM p JOIN w USING (doc_id)),
 m AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram HAVING min(doc_id) <> max(doc_id)),
 r AS (SELECT g.doc_id, pos FROM g JOIN m USING (gram) WHERE g.doc_id > lo),
 c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM r),
 t AS (SELECT doc_id, list(pos) AS cut FROM c GROUP BY doc_id)
 SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN cut IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(cut, i)) END, ' ')) AS kept_sha256
 FROM w LEFT JOIN t USING (doc_id)"""
