"""Operator 13, source divergence audit: how far the words of each source lie from those of other sources of its language.

Indexing in a single pass: a task reads its texts once and counts terms in memory, documents of a term by language and
occurrences by language and source. Once the block has BLOCK postings it is spilled as a run: its terms are dealt by their
checksum over hash shards, sorted, and written in chunks. Runs of a shard are then merged: the chunks come in order of
their first terms, what lies before the next chunk is added up, and at most a chunk of each run stays; where there are
more than FAN_IN runs they are merged in rounds. The merged frequencies are rows (language, term, counts by source).

Sums over all terms of a language come from corrections. With every count at 0 a pair of sources has V times the same
value; terms that one of the two has change it by an amount that depends on the count alone, so a histogram of counts
gives it; only terms that both have need the pair itself, and these corrections are summed as they stream by. All numbers
are whole: p, q, their quotients and sums.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import steps, string_bytes, written

#: Terms occur in so many documents of their language at least.
MIN_DOCS = 3
#: Postings that a task holds before it spills.
BLOCK = 1_000_000
#: Terms in one chunk of a run.
CHUNK = 2_000
#: Terms that a merge holds before it adds up those that are whole.
MERGE_TERMS = 100_000
#: Runs that are merged at once.
FAN_IN = 256
#: Ranks of a group's terms that are returned.
TERM_RANKS = 200
#: Pairs of postings that are corrected in one step.
PAIR_STEP = 1_000_000
#: Pairs of groups that a task sums before it passes them on.
PAIR_ROWS = 500_000
#: Parts that a hot group or language is dealt into.
SALT = 64
SCALE = 1_000_000_000

_TERM_BYTES = bytearray(b" " * 256)
_TERM_BYTES[128:] = range(128, 256)
for _c in range(65, 91):
    _TERM_BYTES[_c] = _TERM_BYTES[_c + 32] = _c + 32
_TERM_BYTES = bytes(_TERM_BYTES)

_LISTS = [("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("sources", pa.list_(pa.list_(pa.int32()))), ("counts", pa.list_(pa.list_(pa.int64()))), ("names", pa.list_(pa.string()))]
_RUN = pa.schema([("run", pa.int64()), ("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), *_LISTS])
_RUN_DDL = "run long, shard int, lang string, first binary, terms array<binary>, docs array<bigint>, sources array<array<int>>, counts array<array<bigint>>, names array<string>"


class _Block:
    """Postings in memory: documents by (language, term), occurrences by (language, source, term)."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        self.docs.setdefault(lang, Counter()).update(set(terms))
        self.counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)

    def size(self) -> int:
        return sum(map(len, self.docs.values())) + sum(len(c) for by in self.counts.values() for c in by.values())

    def chunks(self, run: int, shards: int) -> Iterator[pa.RecordBatch]:
        """The run: for each language and shard its terms in order, CHUNK at a time."""
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            if not terms:
                continue
            place = {t: i for i, t in enumerate(terms)}
            names = list(self.counts[lang])
            by = [self.counts[lang][s] for s in names]
            term = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by])
            source = np.repeat(np.arange(len(by), dtype=np.int32), [len(c) for c in by])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by])
            shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(terms), np.int64)
            rank[order] = np.arange(len(terms))
            post = np.argsort(rank[term], kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rank[term], minlength=len(terms)))]).astype(np.int32)
            inner = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[post])) for x in (source, count)]
            held = pa.array([terms[i] for i in order], pa.binary())
            n_docs = pa.array(np.fromiter((docs[terms[i]] for i in order), np.int64, len(terms)))
            sorted_shard = shard[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_shard[1:] != sorted_shard[:-1]]))
            cuts = np.unique(np.concatenate([np.arange(s, e, CHUNK) for s, e in zip(starts, [*starts[1:], len(terms)])]))
            bounds = pa.array(np.append(cuts, len(terms)).astype(np.int32))
            n = len(cuts)
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (held, n_docs, *inner)]
            firsts = held.take(pa.array(cuts))
            flat = [pa.array(np.full(n, run)), pa.array(sorted_shard[cuts].astype(np.int32)), pa.array([lang] * n), firsts]
            yield pa.RecordBatch.from_arrays([*flat, *lists, pa.array([names] * n, pa.list_(pa.string()))], schema=_RUN)


def runs_of(docs: DataFrame, shards: int, block: int) -> DataFrame:
    """lang, source, text (no nulls) -> the chunks of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, seen = TaskContext.get().partitionId(), 0, _Block(), 0
        for batch in steps(batches):
            data, bounds = string_bytes(batch.column("text"))
            text = data.tobytes().translate(_TERM_BYTES)
            for lang, source, s, e in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                terms = text[s:e].split()
                held.add(lang, source, terms)
                seen += len(terms)
                if seen > block // 4:  # the size is counted now and then only
                    seen = 0
                    if held.size() > block:
                        yield from held.chunks((part << 32) + number, shards)
                        number, held = number + 1, _Block()
        yield from held.chunks((part << 32) + number, shards)

    return docs.select("lang", "source", "text").mapInArrow(run, _RUN_DDL)


@dataclass(frozen=True)
class _Terms:
    """Terms with their documents, and with their postings one after another: places of `names` and occurrences."""

    terms: pa.Array
    docs: np.ndarray
    sizes: np.ndarray  # postings of each term
    source: np.ndarray
    count: np.ndarray

    def where(self, mask: np.ndarray) -> _Terms:
        posts = np.repeat(mask, self.sizes)
        return _Terms(self.terms.filter(pa.array(mask)), self.docs[mask], self.sizes[mask], self.source[posts], self.count[posts])

    def postings(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)


def _sum_terms(held: list[_Terms], names: int, limit: bytes | None) -> tuple[_Terms, _Terms]:
    """The terms before `limit`, in order and added up, and the others as they are."""
    terms = pa.concat_arrays([x.terms for x in held])
    docs, sizes, source, count = (np.concatenate([getattr(x, c) for x in held]) for c in ("docs", "sizes", "source", "count"))
    code = terms.dictionary_encode()
    distinct, code = code.dictionary, code.indices.to_numpy()
    order = pc.sort_indices(distinct)
    rank = np.empty(len(distinct), np.int64)
    rank[order.to_numpy()] = np.arange(len(distinct))
    code = rank[code]
    n = len(distinct) if limit is None else pc.sum(pc.less(distinct, pa.scalar(limit, distinct.type))).as_py() or 0
    done = code < n
    left = _Terms(terms, docs, sizes, source, count).where(~done)
    posts = np.repeat(done, sizes)
    key = np.repeat(code, sizes)[posts] * names + source[posts]
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.zeros(n, np.int64)
    np.add.at(total, code[done], docs[done])
    count = np.add.reduceat(count[posts][by], first) if len(key) else np.empty(0, np.int64)
    key = key[first]
    return _Terms(distinct.take(order[:n]), total, np.bincount(key // names, minlength=n), key % names, count), left


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, str], list[str], _Terms]]:
    """run, shard, lang, names of the sources and sums of their terms, which come in order, of chunks in order of run,
    shard, lang and first term. What is before the first term of the next chunk is whole; what isn't is a chunk of each
    run at most and stays."""
    held: list[_Terms] = []
    names: dict[str, int] = {}
    where: tuple | None = None
    size, most = 0, MERGE_TERMS

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("run", "shard", "lang", "first")))
        lists = [batch.column(c) for c, _ in _LISTS]
        for k, (run, shard, lang, first) in enumerate(keys):
            if (run, shard, lang) != where:
                if held:
                    yield where, list(names), _sum_terms(held, len(names), None)[0]
                where, held, names, size, most = (run, shard, lang), [], {}, 0, MERGE_TERMS
            elif size > most:
                done, left = _sum_terms(held, len(names), first)
                if len(done.terms):
                    yield where, list(names), done
                held, size = [left], len(left.terms)
                most = max(MERGE_TERMS, 2 * size)
            terms, docs, sources, counts, own = (x[k].values for x in lists)
            place = np.array([names.setdefault(x, len(names)) for x in own.to_pylist()], np.int64)
            held.append(_Terms(terms, docs.to_numpy(), sources.value_lengths().to_numpy().astype(np.int64), place[sources.flatten().to_numpy()], counts.flatten().to_numpy()))
            size += len(terms)
    if held:
        yield where, list(names), _sum_terms(held, len(names), None)[0]


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged runs, in chunks of their own."""
    for (run, shard, lang), names, x in _merged(batches):
        cuts = np.arange(0, len(x.terms), CHUNK)
        n, bounds = len(cuts), pa.array(np.append(cuts, len(x.terms)).astype(np.int32))
        posts = [pa.ListArray.from_arrays(pa.array(x.postings()), pa.array(c)) for c in (x.source.astype(np.int32), x.count)]
        lists = [pa.ListArray.from_arrays(bounds, c) for c in (x.terms, pa.array(x.docs), *posts)]
        flat = [pa.array([run] * n, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([lang] * n, pa.string()), x.terms.take(pa.array(cuts))]
        yield pa.RecordBatch.from_arrays([*flat, *lists, pa.array([names] * n, pa.list_(pa.string()))], schema=_RUN)


def frequencies(runs: DataFrame, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN) -> DataFrame:
    """lang, term, total, posts (source, n) of the terms that enough documents have. runs: a written table of chunks."""

    def dealt(runs: DataFrame) -> DataFrame:
        return runs.repartition("run", "shard").sortWithinPartitions("run", "shard", "lang", "first")

    n_runs = runs.select("run").distinct().count()
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        runs = written(dealt(runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(n_runs)))).mapInArrow(_again, _RUN_DDL), "merged-runs")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, lang), names, x in _merged(batches):
            x = x.where(x.docs >= min_docs)
            if not len(x.terms):
                continue
            bounds = x.postings()
            sums = np.concatenate([[0], np.cumsum(x.count)])
            posts = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(x.source)), pa.array(x.count)], names=["source", "n"])
            cols = [pa.array([lang] * len(x.terms), pa.string()), x.terms.cast(pa.string()), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.ListArray.from_arrays(pa.array(bounds), posts)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "term", "total", "posts"])

    one = dealt(runs.withColumn("run", F.lit(0).cast("long")))
    return one.mapInArrow(last, "lang string, term string, total long, posts array<struct<source:string,n:bigint>>")


def share(count: str, total: str, terms: str) -> str:
    """1 + floor(SCALE * (count + 1) / (total + terms)) as SQL; divided in two steps, so that no product leaves 64 bits."""
    a, d = f"({count} + 1) * 100000", f"({total} + {terms})"
    return f"(1 + ({a}) div {d} * 10000 + (({a}) % {d} * 10000) div {d})"


def gain(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _share(count: np.ndarray | int, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    a, d = (count + 1) * 100_000, total + terms
    return 1 + a // d * 10_000 + a % d * 10_000 // d


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a term's postings -> lang, g, h, value: what the terms that both groups have add to the pair's sum."""
    sums: dict[tuple[int, int, int], int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        if sums:
            cols = zip(*sums)
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in cols), pa.array(list(sums.values()), pa.int64())], names=["l", "g", "h", "value"])
            sums.clear()

    for batch in batches:
        posts = batch.column("posts")
        bounds = posts.offsets.to_numpy().astype(np.int64)
        flat = [posts.values.field(i).to_numpy() for i in range(3)]
        lang, terms = batch.column("l").to_numpy(), batch.column("v").to_numpy()
        size = np.diff(bounds)
        work = np.cumsum(size * size)
        at = 0
        while at < len(size):
            upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIR_STEP, side="right")))
            n = size[at:upto]
            a = np.repeat(np.arange(bounds[at], bounds[upto]), np.repeat(n, n))
            row = np.repeat(np.arange(at, upto), n * n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
            b = bounds[row] + inside % np.maximum(size[row], 1)
            apart = a != b
            a, b, row = a[apart], b[apart], row[apart]
            at = upto
            if not len(row):
                continue
            group, count, total = flat
            v = terms[row]
            p, q, p0, q0 = _share(count[a], total[a], v), _share(count[b], total[b], v), _share(0, total[a], v), _share(0, total[b], v)
            value = _gain(p, q) - _gain(p, q0) - _gain(p0, q) + _gain(p0, q0)
            order = np.lexsort((group[b], group[a], lang[row]))
            keys = [x[order] for x in (lang[row], group[a], group[b])]
            start = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            for l, g, h, x in zip(*(k[start].tolist() for k in keys), np.add.reduceat(value[order], start).tolist()):
                sums[l, g, h] = sums.get((l, g, h), 0) + x
            if len(sums) > PAIR_ROWS:
                yield from out()
    yield from out()


def _dealt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALT)).cast("int").alias("salt")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, block: int = BLOCK, fan_in: int = FAN_IN, text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every group, that is (lang, source) of `docs`.

    Part `pair`: every other source of the lang with the sum over the lang's kept terms of floor((p - q)^2 / q), p the
    group's shares and q the other's, ordered by it. Part `term`: the group's terms whose share is above the lang's, by the
    same value, up to term_ranks. Nulls are read as empty. Rows are documents, repeated ones too. A group without a kept
    term takes part in the pairs; a lang without any has values of 0. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (("lang", "lang"), ("source", "source"), (text, "text"))])
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = written(runs_of(clean, shards, block), "runs")
    kept = written(frequencies(runs, min_docs, fan_in), "frequencies")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    posts = kept.select("lang", "term", "total", F.inline("posts"))
    sizes = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = clean.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("n_group"), zero("v"), zero("n_lang"), F.xxhash64("lang").alias("l"), F.xxhash64("lang", "source").alias("g"))
    groups = written(groups, "groups")
    posts = written(posts.join(groups, ["lang", "source"]), "posts")

    p, q = share("n", "n_group", "v"), share("total", "n_lang", "v")
    terms = posts.select("lang", "source", "term", F.expr(p).alias("p"), F.expr(q).alias("q")).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gain("p", "q")).alias("value"))
    order = (F.desc("value"), F.asc("item"))
    terms = terms.withColumn("salt", _dealt("item")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= term_ranks)
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= term_ranks)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    by_term = posts.groupBy("l", "term", "v").agg(F.collect_list(F.struct("g", "n", "n_group")).alias("posts")).where(F.size("posts") > 1)
    both = by_term.select("l", "v", "posts").mapInArrow(_both, "l long, g long, h long, value long").groupBy("l", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    copies = groups.select("l", "v", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.col("g").alias("h"), F.col("n_group").alias("n_h"))
    none = groups.where("v > 0").select("l", "g", "n_group", F.lit(0).cast("long").alias("n"), F.col("v").alias("times"), _dealt("g"))
    some = posts.groupBy("l", "g", "n_group", "n").agg(F.count("*").alias("times")).withColumn("salt", _dealt("g", "n"))
    met = written(none.unionByName(some), "histogram").join(copies, ["l", "salt"]).where("g <> h and v > 0")
    own, bare, other = share("n", "n_group", "v"), share("0", "n_group", "v"), share("0", "n_h", "v")
    met = met.select("l", "g", "h", "n", F.col("times").cast("decimal(38,0)").alias("times"), F.expr(own).alias("p"), F.expr(bare).alias("p0"), F.expr(other).alias("q0"))
    value = F.when(F.col("n") > 0, F.expr(gain("p", "q0")) - F.expr(gain("p0", "q0"))).otherwise(F.expr(gain("p0", "q0")))
    as_p = met.select("l", "g", "h", (F.col("times") * value).cast("decimal(38,0)").alias("value"))
    as_q = met.where("n > 0").select("l", F.col("h").alias("g"), F.col("g").alias("h"), (F.col("times") * (F.expr(gain("q0", "p")) - F.expr(gain("q0", "p0")))).cast("decimal(38,0)").alias("value"))
    sums = both.unionByName(as_p).unionByName(as_q).groupBy("l", "g", "h").agg(F.sum("value").cast("long").alias("value"))
    names = groups.select("lang", "source", "l", "g")
    every = names.withColumn("salt", _dealt("g")).join(groups.select("l", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.col("g").alias("h"), F.col("source").alias("item")), ["l", "salt"]).where("g <> h")
    pairs = every.join(sums, ["l", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_P = "1 + ({s}::HUGEINT * ({c} + 1)) // ({n} + v)"
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
 kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 lt AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
 lv AS (SELECT lang, count(*) AS v, sum(c) AS n FROM lt GROUP BY ALL),
 g AS (SELECT DISTINCT lang, source FROM d),
 gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g),
 full_ AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.c, 0) AS c, {_P.format(s=SCALE, c="coalesce(c.c, 0)", n="gn.n")} AS p FROM gn JOIN kept USING (lang) JOIN lv USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
 pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
 tq AS (SELECT lt.lang, lt.term, {_P.format(s=SCALE, c="lt.c", n="lv.n")} AS q FROM lt JOIN lv USING (lang)),
 tr AS (SELECT f.lang, f.source, 'term' AS part, f.term AS item, (((f.p - q) * (f.p - q)) // q)::BIGINT AS value FROM full_ f JOIN tq ON tq.lang = f.lang AND tq.term = f.term WHERE f.c > 0 AND f.p > q),
 u AS (SELECT * FROM pr UNION ALL SELECT * FROM tr)
 SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u) WHERE part = 'pair' OR rank <= {TERM_RANKS}"""
