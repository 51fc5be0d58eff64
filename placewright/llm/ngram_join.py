"""Operator 9, n-gram Jaccard join by chosen paths.

Each document is its set of five-word shingles. Documents with equal sets are copies and stand as one set. A set has a
signature of minimum hashes, whose coordinates agree for two sets with probability J, their Jaccard similarity. In each
run every set walks down a random tree: at a node one or two coordinates are sampled (the same for all sets there, 1/t
on average at threshold t), and the set goes on under the value it has at each. Two sets at or above the threshold are
expected to share at least one path at any depth, unrelated sets soon share none. Runs are repeated until the target
recall. Sets that end in one bucket are compared by bit sketches; too large a bucket is taken as linked as a whole. The
groups so found hold all candidate links, and every pair inside a group is then checked exactly, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.plans.graph import components

from .common import ROW, by_group, mix, pack, row_key, steps, string_bytes, word_hashes, written

WORDS = 5
THRESHOLD = 0.8
COORDS = 64
DEPTH = 4
RECALL = 0.9995
#: Members of a bucket that are compared with one another; a larger bucket is linked as a whole and left to the check.
BUCKET = 256
#: Sketch bits of 64 that must agree. At J = 0.8 it is 57.6 with deviation 2.4.
SKETCH_BITS = 47
#: Sets in one block of the exact check.
BLOCK = 1024

_rng = np.random.default_rng(9)
_A = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, COORDS, dtype=np.uint64)
_W = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_U = np.uint64


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a bucket with probability `recall`."""
    two = 1 / threshold - 1  # chance of two coordinates at a node
    lost = 0.0
    for _ in range(depth):
        stay = threshold * (1 - lost)
        lost = (1 - two) * (1 - stay) + two * (1 - stay) ** 2
    return math.ceil(math.log(1 - recall) / math.log(lost))


def shingles(words: np.ndarray, first: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of texts whose words start at `first` (n + 1 values); a shorter text is one shingle."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    start = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = first[:-1][text] + np.arange(start[-1]) - start[:-1][text]
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < first[1:][text]
        out += np.where(inside, words[np.minimum(at + j, max(len(words) - 1, 0))], _U(0)) * _W[j] if len(words) else _U(0)
    return mix(out), start


def signatures(hashes: np.ndarray, starts: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Minimum hashes of sets that lie one after another, all of them non-empty."""
    out = np.empty((len(starts), coords), np.uint32)
    for j in range(coords):
        out[:, j] = np.minimum.reduceat(((hashes * _A[j] + _B[j]) >> _U(32)).astype(np.uint32), starts)
    return out


def paths(signature: np.ndarray, runs: int, threshold: float = THRESHOLD, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every path that each signature walks in all runs."""
    two = _U(int((1 / threshold - 1) * 2**32))
    n = len(signature)
    row = np.tile(np.arange(n), runs)
    path = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64)), n)
    for _ in range(depth):
        h = mix(path)
        j = (h % _U(COORDS)).astype(np.int64)
        more = np.flatnonzero((h >> _U(32)) < two)
        other = (j[more] + 1 + ((h[more] >> _U(8)) % _U(COORDS - 1)).astype(np.int64)) % COORDS
        row, j = np.concatenate([row, row[more]]), np.concatenate([j, other])
        path = np.concatenate([path, path[more]])
        path = mix(path * _U(0x9E3779B97F4A7C15) + (j.astype(np.uint64) << _U(32)) + signature[row, j])
    return row, path


def sets_of(rows: DataFrame) -> DataFrame:
    """rows: doc_id, key, text -> doc_id, key, set_id (null without a word), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            words, first = word_hashes(*string_bytes(part.column("text")))
            h, start = shingles(words, first)
            n = np.diff(start)
            some = np.flatnonzero(n)
            ids = np.zeros(len(n), np.uint64)
            for i in some:
                u = np.unique(h[start[i] : start[i + 1]])
                ids[i] = mix(u).sum() + _U(len(u))
            ids = mix(ids).view(np.int64)
            sig: list[bytes | None] = [None] * len(n)
            if len(some):
                found = signatures(h, start[:-1][some])
                for i, s in zip(some, found, strict=True):
                    sig[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(ids, mask=n == 0), pa.array(sig, pa.binary())],
                names=["doc_id", "key", "set_id", "signature"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key long, set_id long, signature binary")


def bucket_entries(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    """sets: set_id, signature -> path, set_id, sketch: one row for each path that a set walks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, COORDS)
                bits = (mix(sig.astype(np.uint64)) & _U(1)) << np.arange(COORDS, dtype=np.uint64)
                sketch = np.bitwise_or.reduce(bits, axis=1).view(np.int64)
                row, path = paths(sig, runs, threshold)
                ids = part.column("set_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row]), pa.array(sketch[row])], names=["path", "set_id", "sketch"])

    return sets.select("set_id", "signature").mapInArrow(run, "path long, set_id long, sketch long")


def least_labels(near: np.ndarray) -> np.ndarray:
    """Component labels of a small dense adjacency matrix: for each node the least index it reaches."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def candidate_edges(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all sets which share a bucket and whose sketches agree; linear in the entries."""
    size = entries.groupBy("path").agg(F.count("*").alias("n"), F.min("set_id").alias("least")).where("n > 1")
    shared = entries.join(size, "path")
    whole = shared.where(F.col("n") > bucket).select(F.col("set_id").alias("a"), F.col("least").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for g in by_group(batches, ["path"]):
            ids = g.column("set_id").to_numpy()
            s = g.column("sketch").to_numpy().view(np.uint64)
            near = 64 - np.bitwise_count(s[:, None] ^ s[None, :]) >= SKETCH_BITS
            label = least_labels(near)
            own = np.flatnonzero(label != np.arange(len(label)))
            if len(own):
                a.append(ids[own])
                b.append(ids[label[own]])
            if len(a) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    few = shared.where(F.col("n") <= bucket).select("path", "set_id", "sketch").repartition("path").sortWithinPartitions("path")
    return whole.unionByName(few.mapInArrow(run, "a long, b long")).where("a <> b").distinct()


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """members: grp, set_id, block, n_blocks, shingles (packed) -> set_id, links, root_set: exact counts for each pair of
    blocks of a group, and for each set the least set it is connected with there."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("o")
    pairs = members.select("grp", "set_id", "block", "shingles", other).select(
        "grp", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "set_id", "block", "shingles"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_group(batches, ["grp", "p", "q"]):
            ids, block = g.column("set_id").to_numpy(), g.column("block").to_numpy()
            p, q = g.column("p")[0].as_py(), g.column("q")[0].as_py()
            near = exact_near([np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()], threshold)
            if p != q:
                near &= block[:, None] != block[None, :]
            label = least_labels(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(near.sum(axis=1, dtype=np.int64)), pa.array(ids[label])], names=["set_id", "links", "root_set"]
            )

    keys = ["grp", "p", "q"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "set_id long, links long, root_set long")


def exact_near(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets (sorted, distinct) have a Jaccard similarity of at least the threshold; the diagonal is False."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((n, n), np.float64)
    if n == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        owner = np.repeat(np.arange(n), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = count > 1  # a shingle of one set alone is in no intersection
        number = np.cumsum(often) - 1
        keep = often[column]
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = max(256, 4_000_000 // n)
        for lo in range(0, int(often.sum()), width):
            s, e = np.searchsorted(column, (lo, lo + width))
            dense = np.zeros((n, width), np.float32)
            dense[owner[s:e], column[s:e] - lo] = 1
            both += dense @ dense.T
    union = size[:, None] + size[None, :] - both
    near = both >= threshold * union - 1e-9
    np.fill_diagonal(near, False)
    return near


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, key, class_id, class_key, n_links, n_copies.

    class_id: the least doc_id of the class, the connected component of links; class_key: the row key of that document.
    n_links: other distinct shingle sets with a similarity of at least `threshold`; n_copies: other rows with the same
    set. Words are split at white space, A-Z read as a-z; texts of under five words are one shingle of all their words.
    Null and empty texts have no shingle: each is a class of its own. Repeated rows (same id and text) share one key and
    count as copies. Null ids sort first. Other columns of `docs` are ignored. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), t.alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    found = written(sets_of(rows), "sets")
    first = F.min(F.struct("doc_id", "key")).alias("first")
    sets = written(found.where("set_id is not null").groupBy("set_id").agg(first, F.count("*").alias("n"), F.first("signature").alias("signature")), "distinct-sets")
    entries = written(bucket_entries(sets, runs_for(recall, threshold), threshold), "paths")
    groups = components(candidate_edges(entries)).select(F.col("id").alias("set_id"), F.col("root").alias("grp"))
    size = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    groups = written(groups.join(size, "grp").withColumn("block", F.pmod(F.xxhash64("set_id"), "n_blocks").cast("int")), "groups")
    chosen = groups.join(sets.select("set_id", F.col("first.key").alias("key")), "set_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            h, start = shingles(*word_hashes(*string_bytes(part.column("text"))))
            sets_ = [pack(np.unique(h[s:e])) for s, e in zip(start, start[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("grp", "set_id", "block", "n_blocks")), pa.array(sets_, pa.binary())], names=["grp", "set_id", "block", "n_blocks", "shingles"])

    texts = rows.select("key", "text").join(chosen, "key").dropDuplicates(["key"]).select("grp", "set_id", "block", "n_blocks", "text")
    members = texts.mapInArrow(packed, "grp long, set_id long, block int, n_blocks int, shingles binary")
    links = written(exact_links(members, threshold), "links")
    roots = components(links.select(F.col("set_id").alias("a"), F.col("root_set").alias("b")))
    n_links = links.groupBy("set_id").agg(F.sum("links").alias("n_links"))
    of_set = sets.select("set_id", "n", "first").join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").join(n_links, "set_id", "left")
    of_set = of_set.withColumn("root", F.coalesce("root", "set_id"))
    head = of_set.groupBy("root").agg(F.min("first").alias("head"))
    of_set = of_set.join(head, "root").select("set_id", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    out = found.select("doc_id", "key", "set_id").join(of_set, "set_id", "left")
    return out.select(
        "doc_id",
        "key",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stand for their class: one row of each class, with the columns of `docs`."""
    keyed = docs.withColumn(ROW, row_key(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    heads = ngram_join(docs, threshold, text=text, key=key).where("key = class_key").select(F.col("key").alias(ROW))
    return keyed.join(heads, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join(docs).select("doc_id", "class_id", "n_links", "n_copies")
