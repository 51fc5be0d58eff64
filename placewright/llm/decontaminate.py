"""Operator 10, benchmark decontamination by latent semantic retrieval.

The benchmark's passages are TF-IDF rows over their own words, with document frequencies counted over all distinct
texts: a passage that is spread in copies doesn't make its own words common. A randomised SVD (range finding by A'A on a
random block, two rounds, each one Spark job that adds up partial products by block of words) gives the latent space.
Every document is cut into overlapping windows; a window whose cosine with an item in that space passes a low threshold
is a candidate. As a space of fixed rank shows only a part of a large benchmark, an index of the items' runs of three
words finds candidates too, whatever the rank. A candidate is then decided on its words: by the longest common
subsequence of item and neighbourhood, and by how many of the item's words, its answer, are there, each weighed by how
telling it is; where all texts have them all, by the subsequence alone. So changed, dropped and added words leave a
match, and shared common words alone don't make one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ROW, Lookup, by_group, mix, pack, plain, plain_bytes, row_key, steps, word_hashes

RANK = 128
#: Features of the latent space: words are dealt over them by their hash, so the space is bounded at one rank for every benchmark.
FEATURES = 1 << 17
#: Words of a unit; windows of two and of four units start at every unit.
UNIT = 12
WINDOWS = (2, 4)
COSINE = 0.3
#: Words by which a look at a window goes further, so that the windows which start there need none.
AGAIN = 2 * UNIT
LCS = 0.6
ANSWER = 0.5
#: Words of an indexed run; a shorter item is one run.
RUN_WORDS = 3
#: Items of as many runs or more need two of them close together, others one.
MANY_RUNS = 16
#: Pairs of a run in a text and an item that has it, looked at in one step (or one text).
PAIRS = 1 << 22
#: Items whose vectors and words go to the tasks in one scan of the documents; a larger benchmark takes more scans.
BLOCK_ITEMS = 20_000
_FEATURE_BLOCK = 4096


@dataclass(frozen=True)
class Space:
    words: np.ndarray  # hashes of the benchmark's words, sorted
    idf: np.ndarray  # of the words
    idf_new: float  # of any other word
    feature: np.ndarray  # of each word
    weight: np.ndarray  # idf of the features: of its texts if no two of its words share one
    basis: np.ndarray  # features x rank, orthonormal


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*plain_bytes(column))


def benchmark_words(items: DataFrame) -> np.ndarray:
    """Hashes of the benchmark's words, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_words(part.column("text"))[0]).view(np.int64))], names=["word"])

    top = items.select("text").mapInArrow(run, "word long").distinct().toPandas()
    return np.sort(top["word"].to_numpy(np.int64).view(np.uint64))


def document_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many distinct texts each word is, over all of them, and the number of distinct texts."""

    find = Lookup(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            h, first = _words(part.column("text"))
            at = find(h)
            sets = [pack(np.unique(x[x >= 0])) for x in np.split(at, first[1:-1])]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())], names=["key", "words"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for x in batch.column("words"):
                total[np.frombuffer(x.as_buffer(), np.int32)] += 1
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["word", "n"])

    sets = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "key long, words binary").dropDuplicates(["key"])
    got = sets.mapInArrow(add, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out, n = np.zeros(len(words), np.int64), 0
    for w, c in zip(got["word"], got["n"], strict=True):
        if w < 0:
            n = int(c)
        else:
            out[w] = c
    return out, n


def _rows(column: pa.Array, space: Space, find: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number (-1: no word of the benchmark) and feature (then one past the last) of each place, its part of the
    squared length, and where the texts start."""
    h, first = _words(column)
    at = find(h)
    feature = np.append(space.feature, len(space.weight))[at]
    return h, at, feature, np.append(space.weight, space.idf_new)[feature] ** 2, first


def gram_product(items: DataFrame, space: Space, z: np.ndarray) -> np.ndarray:
    """A'A z for the TF-IDF rows A (of unit length) of the items, added up by Spark in blocks of features."""
    n, width = z.shape
    find = Lookup(space.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for part in steps(batches):
            _, at, feature, length, first = _rows(part.column("text"), space, find)
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            norm = np.sqrt(np.maximum(np.bincount(doc, weights=length, minlength=part.num_rows), 1e-12))
            m = at >= 0
            at, doc = feature[m], doc[m]
            x = space.weight[at] / norm[doc]
            y = np.zeros((part.num_rows, width))
            np.add.at(y, doc, z[at] * x[:, None])
            np.add.at(total, at, y[doc] * x[:, None])
        blocks = range(0, n, _FEATURE_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([pack(total[b : b + _FEATURE_BLOCK]) for b in blocks])], names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches, ["block"]):
            total = sum(np.frombuffer(p.as_py()) for p in g.column("part"))
            yield pa.RecordBatch.from_arrays([g.column("block").combine_chunks()[:1], pa.array([pack(total)])], names=["block", "part"])

    parts = items.select("text").mapInArrow(run, "block long, part binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((n, width))
    for r in parts.mapInArrow(add, "block long, part binary").collect():
        got = np.frombuffer(r["part"]).reshape(-1, width)
        out[r["block"] : r["block"] + len(got)] = got
    return out


def fit_space(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Space:
    words = benchmark_words(items)
    df, n = document_counts(docs, words)
    idf = np.log((n + 1) / (df + 1))  # next to nothing for a word of nearly all texts, at no point cut off
    slots, feature = np.unique(words % np.uint64(FEATURES), return_inverse=True)
    weight = np.log((n + 1) / (np.minimum(np.bincount(feature, weights=df, minlength=len(slots)), n) + 1))
    space = Space(words, idf, float(np.log(n + 1)), feature, weight, np.zeros((len(slots), 0)))
    if not len(words):
        return space
    rank = min(rank, len(slots))
    wide = min(len(slots), rank + 16)
    z = np.random.default_rng(10).standard_normal((len(slots), wide))
    for _ in range(2):
        z = np.linalg.qr(gram_product(items, space, z))[0]
    values, vectors = np.linalg.eigh(z.T @ gram_product(items, space, z))
    keep = np.argsort(-values)[:rank]
    return replace(space, basis=(z @ vectors[:, keep]).astype(np.float32))


def lcs_length(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in other.tolist():
        m = places.get(w, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


@dataclass(frozen=True)
class Index:
    find: Lookup  # hashes of the runs
    lengths: tuple[int, ...]  # words of the runs that occur
    first: np.ndarray  # where the items of each run start, one more than runs
    items: np.ndarray
    need: np.ndarray  # of each item: different runs that a text must have within `span` words
    span: np.ndarray


_RUN_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words from each place on; len(h) - k + 1 values, texts' ends not heeded."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out += h[j : j + n] * _RUN_FACTORS[j]
    return mix(out)


def index_of(words: list[np.ndarray]) -> Index:
    runs, lengths = [], [min(RUN_WORDS, len(w)) for w in words]
    need = np.ones(len(words), np.int64)
    for j, (w, k) in enumerate(zip(words, lengths, strict=True)):
        some = np.unique(run_hashes(w, k)) if k else np.empty(0, np.uint64)
        need[j] = 2 if len(some) >= MANY_RUNS else 1
        runs.append(np.stack([some, np.full(len(some), j, np.uint64)]))
    run, item = np.concatenate(runs, axis=1) if runs else np.zeros((2, 0), np.uint64)
    order = np.argsort(run, kind="stable")
    every, first = np.unique(run[order], return_index=True)
    reach = np.array([len(w) for w in words], np.int64)
    return Index(Lookup(every), tuple(sorted({k for k in lengths if k})), np.append(first, len(run)), item[order].astype(np.int64), need, 2 * reach + UNIT * max(WINDOWS))


def index_places(index: Index, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, item and place of the run, for places where enough of an item's runs stand close enough together."""
    for k in index.lengths:
        at = np.full(len(h), -1)
        found = index.find(run_hashes(h, k))
        at[: len(found)] = found
        for j in range(1, k):  # runs that go on over the end of their text
            cut = first[1:] - j
            at[cut[cut >= first[:-1]]] = -1
        yield from _close_places(index, at, first)


def _close_places(index: Index, at: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    n = np.where(at >= 0, np.diff(index.first)[at], 0) if len(index.items) else np.zeros(len(at), np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    text = 0
    half = UNIT * max(WINDOWS) // 2
    while text < len(first) - 1:
        upto = max(text + 1, int(np.searchsorted(total[first], total[first[text]] + PAIRS, side="right")) - 1)
        place = np.repeat(np.arange(first[text], first[upto]), n[first[text] : first[upto]])
        of = np.repeat(np.arange(text, upto), total[first[text + 1 : upto + 1]] - total[first[text:upto]])
        text = upto
        if not len(place):
            continue
        begin = index.first[at[place]]
        item = index.items[begin + np.arange(len(place)) - np.searchsorted(place, place)]
        order = np.lexsort((place, item, of))
        of, item, place = of[order], item[order], place[order]
        last = np.arange(len(place)) + index.need[item] - 1
        to = np.minimum(last, len(place) - 1)
        ok = (last < len(place)) & (of[to] == of) & (item[to] == item) & (place[to] - place < index.span[item])
        # All words of a close group are centres, for a match can start before the first of them; one of each `half` is enough.
        edge = np.zeros(len(place) + 1, np.int64)
        np.add.at(edge, np.flatnonzero(ok), 1)
        np.add.at(edge, to[ok] + 1, -1)
        keep = np.cumsum(edge[:-1]) > 0
        of, item, place = of[keep], item[keep], place[keep]
        new = np.ones(len(place), bool)
        new[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (place[1:] // half != place[:-1] // half)
        yield of[new], item[new], place[new]


def matches_of(rows: DataFrame, items: list[tuple], space: Space, item_kind: str = "long") -> DataFrame:
    """rows: doc_id, text; items: (item_id, text) of one block -> doc_id, item_id, cosine, lcs_share, answer_share."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = pa.array([i for i, _ in items], pa.string() if item_kind == "string" else pa.int64())
    column = pa.array([t for _, t in items], pa.string())
    find = Lookup(space.words)
    all_words, at, feature, _, first = _rows(column, space, find)
    item_words = [all_words[s:e] for s, e in zip(first, first[1:])]
    item_telling = [np.unique(at[s:e][at[s:e] >= 0]) for s, e in zip(first, first[1:])]
    telling = [np.maximum(space.idf[x], 0.0) for x in item_telling]
    of_all = [x.sum() for x in telling]
    own = np.repeat(np.arange(len(items)), np.diff(first))
    latent = np.zeros((len(items), space.basis.shape[1]), np.float32)
    scaled = np.append(space.basis * space.weight[:, None].astype(np.float32), np.zeros((1, space.basis.shape[1]), np.float32), axis=0)  # the last: no feature
    np.add.at(latent, own, scaled[feature])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    reach = np.array([len(w) for w in item_words])
    index = index_of(item_words)
    half = UNIT * max(WINDOWS) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(len(space.words) + 1, bool)  # the last is for words that are no feature
        for part in steps(batches):
            h, at, feature, length, first = _rows(part.column("text"), space, find)
            n_words = np.diff(first)
            n_units = -(-n_words // UNIT)
            start = np.concatenate([[0], np.cumsum(n_units)])
            if not start[-1]:
                continue
            doc = np.repeat(np.arange(part.num_rows), n_units)
            unit_at = first[:-1][doc] + UNIT * (np.arange(start[-1]) - start[:-1][doc])
            size = np.add.reduceat(length, unit_at)
            unit = np.zeros((len(doc), latent.shape[1]), np.float32)
            for k in range(UNIT):  # the k-th words of all units
                place = unit_at + k
                on = np.flatnonzero(place < first[doc + 1])
                on = on[at[place[on]] >= 0]
                for c in range(0, len(on), 8192):
                    unit[on[c : c + 8192]] += scaled[feature[place[on[c : c + 8192]]]]
            asked: dict[tuple[int, int, int], int] = {}
            best: dict[tuple[int, int], tuple] = {}

            def look(d: int, j: int, s: int, e: int, cosine: Callable[[np.ndarray], float]) -> None:
                if best.get((d, j), (0.0,))[0] == 1:
                    return
                margin = reach[j] + AGAIN
                s, e = max(first[d], s - margin), min(first[d + 1], e + margin)
                answer = 1.0
                if of_all[j] > 1e-9:
                    there[at[s:e]] = True
                    answer = telling[j] @ there[item_telling[j]] / of_all[j]
                    there[at[s:e]] = False
                if answer < ANSWER:
                    return
                share = lcs_length(item_words[j], h[s:e]) / max(1, reach[j])
                if share >= LCS:
                    best[d, j] = max(best.get((d, j), (0.0, 0.0, 0.0)), (share, float(answer), float(cosine(np.arange(s, e)))))

            for s in range(0, len(doc), 4096):
                e = min(s + 4096, len(doc))
                window, norm, wide = np.zeros((e - s, latent.shape[1]), np.float32), np.zeros(e - s), 0
                for units in WINDOWS:
                    for u in range(wide, units):  # the next unit, where the text goes on
                        on = np.flatnonzero(s + u + np.arange(e - s) < start[doc[s:e] + 1])
                        window[on] += unit[s + u + on]
                        norm[on] += size[s + u + on]
                    wide = units
                    cos = (window @ latent.T) / np.sqrt(np.maximum(norm, 1e-9))[:, None]
                    for i, j in zip(*np.nonzero(cos >= COSINE)):
                        w = int(unit_at[s + i])
                        if w <= asked.get((doc[s + i], j, units), -1):  # the last look saw this window too
                            continue
                        asked[doc[s + i], j, units] = w + AGAIN
                        look(int(doc[s + i]), int(j), w, w + units * UNIT, lambda _, c=cos[i, j]: c)
            for some in index_places(index, h, first):
                for d, j, p in zip(*(x.tolist() for x in some)):
                    look(d, j, p - half, p + half, lambda x, j=j: scaled[feature[x]].sum(axis=0) @ latent[j] / np.sqrt(max(length[x].sum(), 1e-9)))
            if best:
                d, j = np.array(list(best)).T
                got = list(best.values())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(d)), ids.take(pa.array(j)), *(pa.array([g[x] for g in got]) for x in (2, 0, 1))],
                    names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, cosine double, lcs_share double, answer_share double")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The (doc_id, item_id) pairs where a text of `docs` holds an item of `items` (item_id, text), with their scores.

    Null and empty texts hold nothing; of items without a telling word the subsequence decides. Repeated rows of `docs`
    give repeated pairs; of items with one id each gives its own. Item ids are whole numbers (then long) or else strings.
    Null ids are kept. Other columns don't matter. Empty tables on either side give an empty result. Items reach the
    tasks in blocks of BLOCK_ITEMS, one scan of the documents for each block.
    """
    rows = docs.select(F.col(key).alias("doc_id"), plain(text).alias("text"))
    item_kind = "long" if isinstance(items.schema["item_id"].dataType, IntegralType) else "string"
    bench = items.select(F.col("item_id").cast(item_kind).alias("item_id"), plain("text").alias("text"))
    space = fit_space(rows, bench)
    n = bench.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        some = bench.where(F.pmod(row_key(F.col("item_id"), F.col("text")), F.lit(blocks)) == b) if blocks > 1 else bench
        found = matches_of(rows, [(r["item_id"], r["text"]) for r in some.collect()], space, item_kind)
        out = found if out is None else out.unionByName(found)
    return out


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that hold no benchmark item. Rows with the id of a dropped row, or of a null id, are told apart
    by their text."""
    keyed = docs.withColumn(ROW, row_key(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = decontaminate(keyed, items, text, ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return keyed.join(found, ROW, "left_anti").drop(ROW)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
