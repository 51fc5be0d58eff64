"""Operator 5, toxicity by weak supervision.

Voters are simple and many: words of a small lexicon, stems (the first 4 to 7 bytes of a word) that labelled toxic texts
have far more often than clean ones, once or repeatedly, and patterns, some of which speak for clean texts. A voter
speaks or abstains. A generative label model estimates by EM how often each voter speaks on toxic and on clean texts,
starting from and held near the rates that labelled texts show; a single text's given label has no vote. Voters that go
together beyond what the label explains (nested stems above all) are found from the correlations of their residuals,
and share one vote. The model's posterior labels, not the given ones, train a linear classifier over
voters and hit counts; the given labels only set its scale. That classifier scores every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, mix, pack, plain, plain_bytes, remainder, row_key, steps, word_hashes, written
from .ngram_join import least_labels, shingles, signatures

STEMS = (4, 5, 6, 7)
LEXICON = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb hate ugly imbecile retard".split()
#: Voters from labelled texts, at most: those with the strongest evidence.
VOTERS = 400
#: Evidence a stem needs (twice the log likelihood ratio): beyond chance among some hundred thousand stems.
EVIDENCE = 25.0
#: Bound of the sample of labelled texts on which label model and classifier are fitted; voters are counted over all.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Texts that a voter's first rates count as in the label model.
ANCHOR = 50.0
#: Correlation of residuals from which voters share one vote.
TOGETHER = 0.5
#: Words of a shingle. Copies have AGREE of COPY_COORDS minimum hashes of shingles in common, 0.7 of them, and are met where
#: one of the bands of BAND such hashes is equal.
SHINGLE, COPY_COORDS, BAND, AGREE = 3, 32, 4, 22
#: Hash places of the filter by which clean texts' stems are thinned; a fixed size, whatever the corpus.
FILTER_BITS = 24
_PRIOR = 0.1
#: Rows of a matrix of votes that are doubles at once, when models are fitted.
BLOCK = 1_024
_REPEATED = np.uint64(1 << 63)  # in a voter's key: the stem occurs twice or more in the text


def stem_key(word: str, k: int) -> np.uint64:
    raw = word.encode()[:k].ljust(k, b"\0")
    return np.uint64(int.from_bytes(raw, "little") | (k << 56))


def stems(data: np.ndarray, bounds: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Stem keys of all words by length, and the text of each word. Words are parted by blanks."""
    n = len(data)
    word = data != 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    start[inner] = word[inner]
    s = np.flatnonzero(start)
    text = np.searchsorted(bounds, s, side="right") - 1
    stop = np.append(s[1:], n)
    alive = np.ones(len(s), bool)
    key = np.zeros(len(s), np.uint64)
    out = {}
    for j in range(max(STEMS)):
        at = np.minimum(s + j, max(n - 1, 0))
        alive &= (s + j < stop) & (s + j < bounds[text + 1]) & word[at]
        key |= np.where(alive, data[at], 0).astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in STEMS:
            out[j + 1] = key | np.uint64((j + 1) << 56)
    return out, text


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # stem keys of the voters, sorted
    weights: np.ndarray  # of the stems, the patterns, then the counts
    bias: float


def spoken(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text) of every stem that a text has, and again as repeated where it has it twice; words of each text."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(bounds) - 1)
    by, text = stems(data, bounds)
    key = np.concatenate(list(by.values()))
    own = np.tile(text, len(by))
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])) if len(key) else np.empty(0, np.int64)
    twice = first[np.diff(np.append(first, len(key))) > 1]
    return np.concatenate([key[first], key[twice] | _REPEATED]), np.concatenate([own[first], own[twice]]), np.bincount(text, minlength=len(bounds) - 1)


#: Pattern voters over the raw text; True if they speak for toxic texts, False for clean ones.
PATTERNS = (
    ("shout", True, lambda t: (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) * 10 > F.length(t)),
    ("exclaims", True, lambda t: t.contains("!!!")),
    ("masked", True, lambda t: t.rlike(r"[A-Za-z][*@#$]{2,}")),
    ("capitals", True, lambda t: t.rlike(r"(?:\b[A-Z]{3,}[ !?]+){3}")),
    ("figures", False, lambda t: t.rlike(r"(?:[0-9][^0-9]{0,3}){12}")),
    ("listing", False, lambda t: t.rlike(r"\n[-*•] [^\n]*\n[-*•] ")),
)


def _features(part: pa.RecordBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes as (text, voter) pairs in order of the text, stems before patterns, and dense features: votes for toxic
    texts, and those for the words."""
    key, text, words = spoken(*plain_bytes(part.column("text")))
    n = part.num_rows
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    m = keys[at] == key if len(keys) else np.zeros(len(key), bool)
    votes = np.bincount(text[m], minlength=n)
    flags = part.column("flags").to_numpy(zero_copy_only=False).astype(np.int64)
    said, pattern = np.nonzero(flags[:, None] >> np.arange(len(PATTERNS)) & 1)
    row, voter = np.concatenate([text[m], said]), np.concatenate([at[m], len(keys) + pattern])
    order = np.argsort(row, kind="stable")
    return row[order], voter[order], np.stack([np.log1p(votes), np.minimum(1, 10 * votes / np.maximum(words, 20))], axis=1)


def prepared(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The columns `keep`, flags (which patterns speak, a bit each), and text as it is compared."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    flags = reduce(add, (F.when(speaks(t), 1 << i).otherwise(0) for i, (_, _, speaks) in enumerate(PATTERNS)))
    return docs.select(*keep, plain(t).alias("text"), flags.alias("flags"))


def stem_counts(rows: DataFrame, least: np.ndarray | None = None) -> DataFrame:
    """rows: text -> stem, n: in how many texts each stem is, one row more (stem 0) with the number of texts.

    A task adds up its own repeats. least: a filter of FILTER_BITS, packed; stems whose place in it is empty are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, texts = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for part in steps(batches, most=1_000_000):
            key, _, _ = spoken(*plain_bytes(part.column("text")))
            if least is not None:
                at = _place(key)
                key = key[(least[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
            u, n = np.unique(key, return_counts=True)
            both, at = np.unique(np.concatenate([keys, u]), return_inverse=True)
            keys, counts, texts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64), texts + part.num_rows
            if len(keys) > 1_000_000:
                yield out(keys, counts)
                keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield out(np.append(keys, np.uint64(0)), np.append(counts, texts))

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["stem", "n"])

    return rows.select("text").mapInArrow(run, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def _place(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_of(stems_: DataFrame) -> np.ndarray:
    """The places of the stems in a filter of fixed size, eight to a byte; each task sends the places that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[_place(batch.column("stem").to_numpy().view(np.uint64))] = True
            some = np.flatnonzero(np.packbits(bits))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.packbits(bits)[some].astype(np.int64))], names=["at", "bits"])

    got = stems_.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    packed[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    return packed


def choose_voters(labelled: DataFrame, most: int = VOTERS) -> np.ndarray:
    """labelled: text, toxic (0/1). Keys of the lexicon and of the stems that tell toxic texts, counted over all rows.

    Toxic texts come first: a stem in k of them has at most the evidence of one that no clean text has. Only stems that can
    still reach EVIDENCE are then counted in clean texts.
    """
    ones = written(stem_counts(labelled.where("toxic = 1")).withColumnRenamed("n", "ones"), "toxic-stems")
    clean = labelled.where("toxic = 0").count()
    t1 = float((ones.where("stem = 0").agg(F.sum("ones")).first()[0]) or 0)
    t = t1 + clean
    own = np.array([stem_key(w, 7) for w in LEXICON], np.uint64)
    if not t1:
        return np.unique(own)
    a, n = F.col("ones").cast("double"), (F.col("ones") + F.coalesce("zeros", F.lit(0))).cast("double")
    part = lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(0.0)
    able = ones.where("stem <> 0 and ones > 2").where(2 * a * math.log(t / t1) >= EVIDENCE)
    zeros = stem_counts(labelled.where("toxic = 0"), _filter_of(able)).withColumnRenamed("n", "zeros")
    counts = able.join(zeros, "stem", "left")
    g = 2 * (part(a, n * t1 / t) + part(n - a, n * (t - t1) / t))
    tells = counts.where((a / n > 2 * t1 / t) & (g >= EVIDENCE))
    top = tells.withColumn("g", g).orderBy(F.desc("g"), "stem").limit(most).select("stem").toPandas()
    return np.unique(np.concatenate([own, top["stem"].to_numpy(np.int64).view(np.uint64)]))


def _blocks(*parts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Matrices side by side, BLOCK rows of doubles at a time."""
    for s in range(0, len(parts[0]), BLOCK):
        yield slice(s, s + BLOCK), np.concatenate([x[s : s + BLOCK].astype(np.float64) for x in parts], axis=1)


def _sums(votes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """votes.T @ y, by blocks."""
    return sum((v.T @ y[at] for at, v in _blocks(votes)), np.zeros(votes.shape[1]))


def label_model(votes: np.ndarray, given: np.ndarray, prior: float, toxic: np.ndarray | None = None, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row of the 0/1 vote matrix, and for each voter the number of its company.

    given: the labels, which set the first rates of speaking on toxic and on clean texts; these count as ANCHOR texts from
    then on, and no text's own label votes on it. toxic: which voters speak for toxic texts (all); the others speak for
    clean ones. Voters of one side whose residuals correlate above TOGETHER, directly or through others, are one company
    and share one vote in equal parts; between companies votes are independent given the label.
    """
    toxic = np.ones(votes.shape[1], bool) if toxic is None else toxic
    post = _posterior(votes, given, prior, toxic, np.ones(votes.shape[1]), 2)
    rates = _sums(votes, post) / max(post.sum(), 1e-9), _sums(votes, 1 - post) / max((1 - post).sum(), 1e-9)
    both = np.zeros((votes.shape[1], votes.shape[1]))
    for at, v in _blocks(votes):
        residual = v - np.outer(post[at], rates[0]) - np.outer(1 - post[at], rates[1])
        both += residual.T @ residual
    scale = np.sqrt(np.maximum(np.diag(both), 1e-9))
    near = both / np.outer(scale, scale) > TOGETHER
    company = np.unique(least_labels(near & (toxic[:, None] == toxic)), return_inverse=True)[1]
    return _posterior(votes, given, prior, toxic, 1 / np.bincount(company)[company], rounds), company


def _posterior(votes: np.ndarray, given: np.ndarray, prior: float, toxic: np.ndarray, part: np.ndarray, rounds: int) -> np.ndarray:
    """EM over the voters' rates, from those of the given labels; part: of a vote, of each voter."""
    first1, first0 = (_sums(votes, given) + 0.5) / (given.sum() + 1), (_sums(votes, 1 - given) + 0.05) / ((1 - given).sum() + 1)
    post = given
    for r in range(rounds):
        p1, p0 = first1, first0
        if r:
            p1 = (_sums(votes, post) + ANCHOR * first1) / (post.sum() + ANCHOR)
            p0 = (_sums(votes, 1 - post) + ANCHOR * first0) / ((1 - post).sum() + ANCHOR)
        p1 = np.where(toxic, np.maximum(p1, p0 * 1.5), np.minimum(p1, p0 / 1.5))  # a voter speaks for its side alone
        p1, p0 = np.clip(p1, 1e-6, 0.999), np.clip(p0, 1e-6, 0.999)
        yes, no = np.log(p1 / p0), np.log((1 - p1) / (1 - p0))
        said = np.concatenate([v @ (part * (yes - no)) for _, v in _blocks(votes)]) if len(votes) else np.empty(0)
        logit = np.log(prior / (1 - prior)) + said + (part * no).sum()
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def fit_linear(x: np.ndarray | tuple[np.ndarray, ...], y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression on soft labels by damped Newton steps; the last weight is the bias. Several matrices
    are taken side by side. Sums go over blocks of rows, so no second copy of the whole is made."""
    parts = (*(x if isinstance(x, tuple) else (x,)), np.ones((len(y), 1), np.uint8))
    n = sum(p.shape[1] for p in parts)
    w = np.zeros(n)
    w[-1] = np.log(_PRIOR / (1 - _PRIOR))
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        own = 0.0
        for at, b in _blocks(*parts):
            z = b @ w
            own += float((np.logaddexp(0, z) - y[at] * z).sum())
        return own + float(0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        h, g = np.diag(penalty), penalty * w
        for at, b in _blocks(*parts):
            p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
            h += (b * (p * (1 - p))[:, None]).T @ b
            g += b.T @ (p - y[at])
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-6 * (1 + now):
            break
        w, now = w - size * step, new
    return w


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: key, text, flags, toxic of training_rows. Voters are counted over all rows; about `sample` of them, by a
    hash of their keys, fit the label model and the classifier."""
    keys = choose_voters(labelled)
    share = min(1.0, sample / max(labelled.count(), 1))
    some = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, most=1_000_000):
            row, voter, dense = _features(part, keys)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            votes = [pack(voter[s:e].astype(np.uint16)) for s, e in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(votes), pa.array([pack(d) for d in dense]), part.column("toxic")], names=["key", "votes", "dense", "toxic"])

    got = some.mapInArrow(run, "key long, votes binary, dense binary, toxic int").toPandas().sort_values("key")
    m = len(keys) + len(PATTERNS)
    toxic = np.append(np.ones(len(keys), bool), [x for _, x, _ in PATTERNS])
    given = got["toxic"].to_numpy(np.float64)
    if not len(got) or given.min() == given.max():  # nothing to tell apart: the lexicon alone speaks
        return Model(keys, np.concatenate([np.full(len(keys), 4.0), np.zeros(len(PATTERNS) + 2)]), float(np.log(_PRIOR / (1 - _PRIOR))))
    votes = np.zeros((len(got), m), np.uint8)
    for i, v in enumerate(got["votes"]):
        votes[i, np.frombuffer(v, np.uint16)] = 1
    dense = np.stack([np.frombuffer(d) for d in got["dense"]])
    prior = float(np.clip(given.mean(), 0.01, 0.5))
    del got
    post, _ = label_model(votes, given, prior, toxic)
    w = fit_linear((votes, dense), post)
    # The given labels set the scale: one factor and one shift for all texts.
    logit = np.concatenate([b @ w[:-1] + w[-1] for _, b in _blocks(votes, dense)])
    scale, shift = fit_linear(logit[:, None], given, ridge=1e-3)
    if scale <= 0:
        scale, shift = 1.0, 0.0
    return Model(keys, w[:-1] * scale, float(w[-1] * scale + shift))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs`, score (0 to 1) and predicted (1 from THRESHOLD on). Null and empty texts get the
    score of a text without a vote. Rows are independent: repeated rows repeat, an empty table stays empty."""
    keep = keep if keep is not None else ["doc_id"]
    rows = prepared(docs, text, [F.col(c) for c in keep])
    m = len(model.keys) + len(PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, most=1_000_000):
            row, voter, dense = _features(part, model.keys)
            logit = model.bias + np.bincount(row, weights=model.weights[voter], minlength=part.num_rows) + dense @ model.weights[m:]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """key, text, flags, toxic of the labelled documents that may be learned from; written.

    Several labels of one id: its greatest counts. Of copies and near copies one document is taken, a toxic one if there
    is: the words of a text that was copied a thousand times are no evidence a thousand times over. A document is left out
    only for the first one of a band that it shares (see BAND), toxic ones first, and only if most of their minimum hashes
    agree; so a shared line alone leaves none out. Copies are found among ids and hashes; only then do texts meet their
    labels. Texts without a word are copies of one another.
    """
    given = labels.where("doc_id is not null and toxic is not null").where(learn)
    given = given.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = prepared(docs.where(learn).select("doc_id", "text"), "text", [F.col("doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            h, start = shingles(*word_hashes(*plain_bytes(part.column("text"))), SHINGLE)
            least, some = np.zeros((part.num_rows, COPY_COORDS), np.uint32), np.flatnonzero(np.diff(start))
            if len(some):
                least[some] = signatures(h, start[some], COPY_COORDS)
            flat = pa.array(least.view(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, COPY_COORDS), pa.int32()), flat)], names=["doc_id", "least"])

    kind = own.schema["doc_id"].dataType.simpleString()
    rank = F.col("toxic").cast("long") * (1 << 62) - F.shiftright(F.abs(F.xxhash64("doc_id")), 2)
    signed = own.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, least array<int>").join(given, "doc_id").withColumn("rank", rank)
    # Equal signatures are one row before bands are dealt, so exact copies don't make one of them hot.
    alike = signed.groupBy("least").agg(F.max(F.struct("rank", "doc_id", "toxic")).alias("first")).select("least", "first.*")
    bands = [F.xxhash64(F.lit(i), F.slice("least", i + 1, BAND)) for i in range(0, COPY_COORDS, BAND)]
    banded = written(alike.withColumn("band", F.explode(F.array(*bands))), "copies")
    head = F.max(F.struct("rank", "least")).alias("head")
    heads = written(banded.groupBy("band").agg(head, F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    agree = F.size(F.filter(F.zip_with("least", "head.least", lambda a, b: a == b), lambda x: x))
    copies = banded.join(heads, "band").where(F.col("head.rank") > F.col("rank")).where(agree >= AGREE).select("doc_id")
    first = banded.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = first.join(copies.distinct(), "doc_id", "left_anti").withColumn("key", F.xxhash64("doc_id"))
    return written(own.hint("merge").join(chosen, "doc_id").select("key", "text", "flags", "toxic"), "labelled")


def not_toxic(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with the columns of `docs`."""
    keyed = docs.withColumn(ROW, row_key(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    model = fit(training_rows(docs, labels, learn))
    bad = score(keyed, model, keep=[ROW]).where("predicted = 1").select(ROW).distinct()
    return keyed.join(bad, ROW, "left_anti").drop(ROW)


def learned_from() -> Column:
    return F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learned_from()))
    marked = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    return score(marked, model, keep=["doc_id", "held_out"])
