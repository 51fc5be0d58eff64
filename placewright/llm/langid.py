"""Operator 3, language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: for every context of up to `order` bytes the counts of the bytes
that followed it. With frozen statistics the probability of byte s after context x is, by escape method C,

    count(s, x) / (total(x) + kinds(x))                    where s was seen after x,
    kinds(x) / (total(x) + kinds(x)) * P(s | shorter x)    where it was not (no factor if x itself was never seen),

down to the empty context and at last to 1/256. The code length of a text is the sum of -log2 P. Because the statistics
are frozen, the code length of a byte depends on its last `order` bytes alone. Tables hold what each language has seen of
a (context, byte), sparsely, so they grow with the number of languages and not with its square; those small enough are
written out for all languages side by side, so that a byte takes one look-up there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, Lookup, remainder, steps, string_bytes

ORDER = 4
TEXT, SOME = f"{OWN}text", f"{OWN}some"
#: Bound of the labelled sample: bytes of training text per language, taken in order of a hash of the text.
TRAIN_BYTES = 300_000
#: Characters that one labelled text gives to the sample at most, as a run from any part of it, so that one long text isn't
#: the whole sample.
TRAIN_TEXT_CHARS = 6_000
#: The table of a gram length is written out for all languages where that takes no more bytes.
DENSE_BYTES = 32_000_000


def grams(data: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """For each byte the last k bytes up to and with it, as one number; bytes before the text's start are 0."""
    out = data.astype(np.uint64)
    for j in range(1, k):
        part = np.zeros(len(data), np.uint64)
        part[j:] = data[:-j]
        for d in range(j):  # bytes of the text before
            at = bounds[:-1] + d
            part[at[at < bounds[1:]]] = 0
        out |= part << np.uint64(8 * j)
    return out


class Rows:
    """Sparse rows: for each key the languages that have it, with a value each."""

    def __init__(self, keys: np.ndarray, languages: np.ndarray, values: np.ndarray) -> None:
        self.keys, first = np.unique(keys, return_index=True)  # `keys` ascend
        self.start = np.append(first, len(keys))
        self.languages, self.values = languages.astype(np.uint16), values.astype(np.float32)

    def add(self, out: np.ndarray, keys: np.ndarray) -> None:
        """Adds to each row of `out` the values of its key, by language."""
        if not len(self.keys):
            return
        row = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[row] == keys)
        first = self.start[row[at]]
        n = self.start[row[at] + 1] - first
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(at, n), self.languages[entry]] += self.values[entry]


class Dense:
    """The rows of one gram length written out for all languages: a look-up a byte where they are few."""

    def __init__(self, grams: np.ndarray, cost: np.ndarray, contexts: np.ndarray, escape: np.ndarray) -> None:
        self.find, self.cost, self.context, self.escape = Lookup(grams), cost, Lookup(contexts), escape


class Trees:
    """The context trees of several languages with frozen statistics, joined into one table for each gram length.

    The code length of byte s after context x of k bytes is that after the shorter context, plus the escape where the language
    knows x, plus a correction where it knows s after x. So only what a language knows is stored, and the tables grow with the
    sum of the languages' own grams. A table of at most dense_bytes when written out for all languages is written out, with
    the same values. Languages: fewer than 65,536.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, dense_bytes: int = DENSE_BYTES) -> None:
        self.languages, self.order = sorted(samples), order
        n = len(self.languages)
        self.tables: list[Dense | tuple[Rows, Rows]] = []  # by k: contexts, and grams of k + 1 bytes
        texts = []
        for lang in self.languages:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in samples[lang]])]).astype(np.int64)
            texts.append((np.frombuffer(b"".join(samples[lang]), np.uint8), bounds))
        known, cost = np.empty(0, np.uint64), np.empty(0)  # of the shorter grams: (gram, language) and bits
        for k in range(order + 1):
            own = [np.unique(grams(data, bounds, k + 1), return_counts=True) for data, bounds in texts]
            pair = np.concatenate([np.empty(0, np.uint64), *((g << np.uint64(16)) | np.uint64(i) for i, (g, _) in enumerate(own))])
            count = np.concatenate([np.empty(0, np.int64), *(c for _, c in own)])
            order_of = np.argsort(pair)
            pair, count = pair[order_of], count[order_of]
            gram, lang = pair >> np.uint64(16), pair & np.uint64(0xFFFF)
            context, of = np.unique((gram >> np.uint64(8) << np.uint64(16)) | lang, return_inverse=True)
            total, kinds = np.bincount(of, count, len(context)), np.bincount(of, minlength=len(context))
            escape = np.log2((total + kinds) / kinds)
            shorter = cost[np.searchsorted(known, ((gram & _low(k)) << np.uint64(16)) | lang)] if k else 8.0
            known, cost = pair, np.log2((total + kinds)[of] / count)
            after = Rows(context >> np.uint64(16), context & np.uint64(0xFFFF), escape)
            seen = Rows(gram, lang, cost - escape[of] - shorter)
            if 4 * n * len(seen.keys) <= dense_bytes:
                bits = self._add(after, seen, self.bits(seen.keys & _low(k), k - 1), seen.keys)
                leave = np.zeros((len(after.keys), n), np.float32)
                after.add(leave, after.keys)
                self.tables.append(Dense(seen.keys, bits, after.keys, leave))
            else:
                self.tables.append((after, seen))

    @staticmethod
    def _add(after: Rows, seen: Rows, shorter: np.ndarray, keys: np.ndarray) -> np.ndarray:
        after.add(shorter, keys >> np.uint64(8))
        seen.add(shorter, keys)
        return shorter

    def bits(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last bytes of grams of k + 1 bytes, by language."""
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        table = self.tables[k]
        if isinstance(table, tuple):
            return self._add(*table, self.bits(keys & _low(k), k - 1), keys)
        out = np.empty((len(keys), len(self.languages)), np.float32)
        row = table.find(keys)
        hit = row >= 0
        out[hit] = table.cost[row[hit]]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            rest = keys[miss]
            at = table.context(rest >> np.uint64(8))
            out[miss] = self.bits(rest & _low(k), k - 1)
            out[miss[at >= 0]] += table.escape[at[at >= 0]]
        return out

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text under each language, worked out for as many bytes at once as make 8,000,000 figures."""
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        keys = grams(data, bounds, self.order + 1)
        step = max(1, 8_000_000 // max(1, len(self.languages)))
        for s in range(0, len(keys), step):
            e = min(s + step, len(keys))
            bits = self.bits(keys[s:e], self.order)
            inside = np.arange(np.searchsorted(bounds, s, "right") - 1, np.searchsorted(bounds, e, "left"))
            first = np.maximum(bounds[inside], s)
            some = np.minimum(bounds[inside + 1], e) > first
            total[inside[some]] += np.add.reduceat(bits, first[some] - s, axis=0, dtype=np.float64)
        return total


def _low(k: int) -> np.uint64:
    """Mask of the last k bytes."""
    return np.uint64((1 << (8 * k)) - 1)


def labelled_sample(rows: DataFrame, bytes_each: int = TRAIN_BYTES, text_chars: int = TRAIN_TEXT_CHARS) -> dict[str, list[bytes]]:
    """A bounded sample of labelled texts: of every language the distinct texts of the least hashes, up to bytes_each in all.

    rows: lang, text. Only the rows that fit reach the driver, so what it gets grows with the number of languages alone.
    """
    h = F.xxhash64("text")
    rows = rows.where("lang is not null and length(text) > 0").select("lang", "text", h.alias("h"))
    size = F.avg(F.least(F.octet_length("text"), F.lit(text_chars)))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg((F.approx_count_distinct("h") * size).alias("n")).collect()}
    if not n:
        return {}
    # About four times the bytes of the sample, however short the texts.
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, 4.0 * bytes_each / v))])
    # Each row passes by a hash of its own text, so each task thins out alone, and of copies one is left after a partial
    # aggregate; the window then sees a bounded number.
    few = rows.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - text_chars, F.lit(0)) + 1).cast("int") + 1
    few = few.select("lang", "h", F.substr("text", at, F.lit(text_chars)).alias("t")).dropDuplicates(["lang", "h"])
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "t")
    few = few.withColumn("upto", F.sum(F.octet_length("t")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out: dict[str, list[bytes]] = {}
    for r in few.where(F.coalesce("upto", F.lit(0)) < bytes_each).orderBy("lang", "h", "t").collect():
        out.setdefault(r["lang"], []).append(r["t"].encode())
    return out


def identify(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns `keep` of `docs`: the language of the least code length, and its share of
    the probability at equal priors. Null texts, and texts without a letter, are `und` with score 0. Ties go to the
    first language in alphabetical order. Rows are independent: repeated rows repeat, an empty table stays empty.
    """
    keep = keep if keep is not None else ["doc_id"]
    rows = docs.select(*keep, F.col(text).cast("string").alias(TEXT), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(SOME))
    names = np.array([*trees.languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, TEXT, 1_000_000):
            data, bounds = string_bytes(part.column(TEXT))
            bits = trees.code_lengths(data, bounds)
            best = np.argmin(bits, axis=1)
            least = bits[np.arange(len(bits)), best]
            score = 1 / np.exp2(np.maximum(-1000.0, least[:, None] - bits)).sum(axis=1)
            some = part.column(SOME).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(names[np.where(some, best, -1)]), pa.array(np.where(some, score, 0.0))],
                names=[*keep, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    if not trees.languages:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
    trees = Trees(labelled_sample(docs.where(~F.col("held_out")).select("lang", "text")))
    return identify(docs.drop("lang"), trees, keep=["doc_id", "held_out"])
