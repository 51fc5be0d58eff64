"""Operator 8, secret scans: rules find base spans, a character convolutional network judges every other candidate.

Base spans come from three patterns and always stay. Further candidates are runs of 16 or more token characters with
letters and digits, or with letters that change their case again and again. The network reads a candidate with its
surroundings as character classes: an embedding, one convolution, the greatest response of each filter, one linear layer.
A long candidate is read piece by piece to its end; its logit is the mean of theirs.

It is trained with numpy on labelled findings of all distinct documents, after a start on a bounded sample of them: base spans and generated keys of well
known formats against the texts' own words, numbers and addresses and generated look-alikes (identifiers, paths, UUIDs,
times, model numbers, picture data), both kinds of generated strings in the same surroundings. Shards of the findings, dealt by the texts'
hashes, train on from the start's weights each, and the mean of theirs, weighed by findings, is the network. A temperature calibrates it
on the held-out findings of all documents, and its threshold is the highest that keeps the wanted recall there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, steps, string_bytes, written

KINDS = ("assign", "access", "hex", "other")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Characters of a candidate that the network reads at a time, and of the text on either side of the candidate.
INSIDE, AROUND = 48, 24
WIDTH = INSIDE + 2 * AROUND
#: Bound of the sample of texts that the network is trained on, of those with and without base findings each, and of the
#: findings that one text gives of each kind.
FINDINGS, EACH = 4_000, 2
RECALL = 0.98
#: Parts of the findings that train on by themselves, one after another in a task; one in HELD texts is held out of all.
SHARDS, HELD = 64, 5
#: Texts of a shard whose findings are shuffled and learned at once.
TEXTS = 500
#: Parts of a logit that held-out findings are counted by.
LOGIT = 64
#: Candidates that are scored at once.
_BATCH = 4096
_FILTERS, _SPAN, _EMBED = 32, 5, 12


def _class_bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IS_HEX = _class_bytes("0123456789abcdef")
_IS_RUN = _class_bytes(_DIGITS + _LETTERS + "+/_=-")
_IS_DIGIT, _IS_LETTER = _class_bytes(_DIGITS), _class_bytes(_LETTERS)
_IS_SMALL, _IS_CAPITAL = _class_bytes(_LETTERS[:26]), _class_bytes(_LETTERS[26:])
#: Number of a character for the network: ASCII from 1 on, other letters 97, else 98; 0 is padding.
_CODES = 99


def _code(c: str) -> int:
    o = ord(c)
    return o - 31 if 32 <= o < 127 else 97 if c.isalpha() else 98


def windows(text: str, start: int, end: int) -> list[list[int]]:
    """A candidate, in pieces of INSIDE characters, each with the text around the candidate, as padded codes."""
    before, after = list(map(_code, text[max(0, start - AROUND) : start])), list(map(_code, text[end : end + AROUND]))
    left, right = [0] * (AROUND - len(before)) + before, after + [0] * (AROUND - len(after))
    inner = list(map(_code, text[start:end]))
    pieces = [inner[i : i + INSIDE] for i in range(0, len(inner), INSIDE)]
    if len(pieces) > 1 and len(pieces[-1]) < INSIDE // 2:  # the end of a long candidate is read with what is before it
        pieces[-1] = inner[-INSIDE:]
    return [left + x + [0] * (INSIDE - len(x)) + right for x in pieces]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules, in order; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def mixed(digits: np.ndarray | int, letters: np.ndarray | int, turns: np.ndarray | int) -> np.ndarray | bool:
    """Whether a run's digits, letters and changes from small to capital letters make it worth a look."""
    return (digits >= 2) & (letters >= 2) | (turns >= 3)


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of token characters of mixed kinds that touch no base span."""
    out = []
    starts = [x for x, _, _ in base]
    reach = list(accumulate((y for _, _, y in base), max))  # the furthest end of the base spans up to each
    for m in RUN.finditer(text):
        s, e = m.span()
        c = np.frombuffer(m[0].encode(), np.uint8)
        if mixed(int(_IS_DIGIT[c].sum()), int(_IS_LETTER[c].sum()), int((_IS_SMALL[c[:-1]] & _IS_CAPITAL[c[1:]]).sum())) and not ((k := bisect_left(starts, e)) and reach[k - 1] > s):
            out.append((s, 3, e))
    return out


def _long_runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    s, e = edge[::2], edge[1::2]
    long = e - s >= least
    return s[long], e[long]


def worth_reading(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts may hold a candidate at all: by runs of bytes, and by the words of the first rule."""
    out = np.zeros(len(bounds) - 1, bool)
    s, e = _long_runs(_IS_HEX[data], 32)  # a run of bytes may go on over the end of a text: then both are read
    for a, b in zip(np.searchsorted(bounds, s, side="right") - 1, np.searchsorted(bounds, e - 1, side="right") - 1):
        out[a : b + 1] = True
    s, e = _long_runs(_IS_RUN[data], 16)
    if len(s):
        turn = np.append(_IS_SMALL[data[:-1]] & _IS_CAPITAL[data[1:]], False)
        some = mixed(*(np.add.reduceat(np.append(t, 0), np.stack([s, e], 1).ravel(), dtype=np.int64)[::2] for t in (_IS_DIGIT[data], _IS_LETTER[data], turn)))
        first = np.searchsorted(bounds, s[some], side="right") - 1
        last = np.searchsorted(bounds, e[some] - 1, side="right") - 1
        for a, b in zip(first.tolist(), last.tolist()):
            out[a : b + 1] = True
    return out


# ---- the network


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    threshold: float = 0.5

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.embed[x]  # n, WIDTH, _EMBED
        patches = np.lib.stride_tricks.sliding_window_view(v, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - _SPAN + 1, -1)
        z = patches @ self.kernel + self.bias
        at = z.argmax(axis=1)
        return patches, at, np.maximum(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0], 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [self._hidden(x[i : i + 512])[2] @ self.out + self.out_bias for i in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.empty(0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.probability(self.logits(x))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float, memory: dict) -> None:
        """One Adam step on a batch."""
        patches, at, h = self._hidden(x)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
        d = (p - y) / len(y)
        dh = d[:, None] * self.out * (h > 0)
        chosen = patches[np.arange(len(x))[:, None], at]  # n, filters, span * embed
        dk = np.einsum("nf,nfk->kf", dh, chosen)
        dv = np.einsum("nf,kf->nfk", dh, self.kernel).reshape(len(x), _FILTERS, _SPAN, _EMBED)
        de = np.zeros_like(self.embed)
        np.add.at(de, x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(_SPAN)], dv)
        memory["t"] = memory.get("t", 0) + 1
        for name, g in (("embed", de), ("kernel", dk), ("bias", dh.sum(0)), ("out", h.T @ d), ("out_bias", d.sum())):
            m, v = memory.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            memory[name] = m, v
            t = memory["t"]
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))


def train(x: np.ndarray, y: np.ndarray, recall: float = RECALL, seed: int = 8) -> Network:
    """Fit on four fifths of the findings; temperature and threshold on the rest."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (_CODES, _EMBED)), rng.normal(0, 0.15, (_SPAN * _EMBED, _FILTERS)), np.zeros(_FILTERS), rng.normal(0, 0.2, _FILTERS), 0.0)
    if len(set(y.tolist())) < 2:
        net.out[:], net.out_bias, net.threshold = 0, -10.0, 1.0  # nothing to learn from: no further span
        return net
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, own = order[:cut], order[cut:]
    memory: dict = {}
    for _ in range(max(4, 12_000 // max(len(own), 1))):
        for i in range(0, len(own), 64):
            b = own[i : i + 64]
            net.step(x[b], y[b], 3e-3, memory)
        own = rng.permutation(own)
    z = net.logits(x[held])
    temps = np.geomspace(0.5, 8, 25)
    loss = [np.logaddexp(0, -(2 * y[held] - 1) * z / t).sum() for t in temps]
    net.temperature = float(temps[int(np.argmin(loss))])
    s, good = net.scores(x[held]), y[held] == 1
    net.threshold = float(np.quantile(s[good], 1 - recall)) if good.any() else 0.5
    return net


_HEXES, _ALNUM, _URL = "0123456789abcdef", _DIGITS + _LETTERS, _DIGITS + _LETTERS + "-_"


def _drawn(rng: np.random.Generator, chars: str, n: int) -> str:
    return "".join(chars[i] for i in rng.integers(0, len(chars), n))


def made_key(rng: np.random.Generator) -> str:
    """A key of one of the usual formats."""
    kinds = (
        lambda: f"gh{_drawn(rng, 'pousr', 1)}_{_drawn(rng, _ALNUM, 36)}",
        lambda: f"{['sk', 'pk', 'rk'][rng.integers(3)]}-{_drawn(rng, _ALNUM, int(rng.integers(24, 52)))}",
        lambda: f"sk_live_{_drawn(rng, _ALNUM, int(rng.integers(24, 40)))}",
        lambda: f"xox{_drawn(rng, 'bpars', 1)}-{_drawn(rng, _DIGITS, 11)}-{_drawn(rng, _DIGITS, 11)}-{_drawn(rng, _ALNUM, 24)}",
        lambda: "AIza" + _drawn(rng, _URL, 35),
        lambda: f"{['glpat', 'npm', 'pypi', 'dop_v1'][rng.integers(4)]}{_drawn(rng, '-_', 1)}{_drawn(rng, _URL, int(rng.integers(20, 40)))}",
        lambda: "eyJ" + _drawn(rng, _URL, int(rng.integers(30, 200))),
        lambda: _drawn(rng, _ALNUM + "+/", 40),
        lambda: _drawn(rng, _ALNUM, int(rng.integers(20, 48))),
    )
    return kinds[rng.integers(len(kinds))]()


def made_look_alike(rng: np.random.Generator, words: list[str]) -> str:
    """A long run with letters and digits that is no key: an identifier, path, UUID, time, model number or picture data."""
    word = lambda: words[rng.integers(len(words))]
    number = lambda: _drawn(rng, _DIGITS, int(rng.integers(1, 5)))
    some = lambda lo, hi: [word() for _ in range(rng.integers(lo, hi))]
    kinds = (
        lambda: "-".join(_drawn(rng, _HEXES, n) for n in (8, 4, 4, 4, 12)),
        lambda: "/" + "/".join(some(2, 6)) + f"/{word()}{_drawn(rng, '_-', 1)}{number()}",
        lambda: "_".join(some(2, 5)) + f"_{number()}",
        lambda: "".join(w.capitalize() for w in some(3, 6)) + number(),
        lambda: "-".join(some(1, 4)) + f"-{_drawn(rng, _LETTERS[26:], 2)}{_drawn(rng, _DIGITS, 4)}-{word()}-{_drawn(rng, _DIGITS, 4)}",
        lambda: f"20{_drawn(rng, _DIGITS, 2)}-0{_drawn(rng, '123456789', 1)}-1{_drawn(rng, _DIGITS, 1)}T{_drawn(rng, _DIGITS, 6)}Z-{word()}",
        lambda: f"{word()}_{_drawn(rng, _DIGITS, 4)}_{_drawn(rng, _DIGITS, 2)}_{_drawn(rng, _DIGITS, 2)}_{word()}",
        lambda: "/".join(some(1, 4)) + f"/{_drawn(rng, _DIGITS, 4)}/{_drawn(rng, _DIGITS, 2)}/" + "-".join(some(2, 6)),
        lambda: "iVBORw0KGgo" + "A" * int(rng.integers(4, 12)) + _drawn(rng, _ALNUM + "+/", int(rng.integers(10, 40))) + "A" * int(rng.integers(4, 12)),
        lambda: "=" * int(rng.integers(3, 8)) + word() + number() + "-" * int(rng.integers(8, 30)),
    )
    out = kinds[rng.integers(len(kinds))]()
    return out if len(out) >= 16 else out + "_" + "_".join(some(3, 6))


def findings_of(text: str, seed: int, each: int = EACH) -> tuple[list[list[int]], list[int]]:
    """Windows and labels of one text: base spans and made keys (1); own words and look-alikes (0). Places by the seed."""
    rng = np.random.default_rng(seed % (1 << 63))
    base = base_spans(text)
    words = [w.lower() for w in _PLAIN_WORD.findall(text, 0, 20_000)] or ["data", "image", "index", "module"]
    xs, ys = [], []

    def add(t: str, s: int, e: int, label: int) -> None:
        for x in windows(t, s, e)[:4]:
            xs.append(x)
            ys.append(label)

    for i in rng.permutation(len(base))[:each]:
        add(text, base[i][0], base[i][2], 1)
    for _ in range(each):
        at = int(rng.integers(0, len(text) + 1))
        m = _PLAIN.search(text, at) or _PLAIN.search(text)
        if m and not any(m.start() < e and s < m.end() for s, _, e in base):
            add(text, *m.span(), 0)
        for label in (1, 0):
            made = made_key(rng) if label else made_look_alike(rng, words)
            before = text[max(0, at - AROUND) : at] + ("", " ", "\n", ": ", ' = "', "id=", "url ")[rng.integers(7)]
            add(before + made + ("", " ", '"', ".", "\n", ", ")[rng.integers(6)] + text[at : at + AROUND], len(before), len(before) + len(made), label)
    return xs, ys


_PLAIN = re.compile(r"[^\W\d_]{7,}|\d{9,}|[\w.]+@[\w.]+|\S+\.\S{2,}")
_PLAIN_WORD = re.compile(r"\b[A-Za-z]{3,10}\b")


def _findings(rows: DataFrame) -> DataFrame:
    """rows: text, h (its hash) -> h, x, y: packed windows and labels of each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps([batch]):
                hs, got = part.column("h"), [findings_of(t, h) for t, h in zip(part.column("text").to_pylist(), part.column("h").to_pylist(), strict=True)]
                x, y = ([pack(np.array(g[i], t)) for g in got] for i, t in ((0, np.uint8), (1, np.int8)))
                yield pa.RecordBatch.from_arrays([hs, pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["h", "x", "y"])

    return rows.select("text", "h").mapInArrow(run, "h long, x binary, y binary").dropDuplicates(["h"])


def _unpacked(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDTH).astype(np.int64), np.frombuffer(b"".join(y), np.int8).astype(np.float64)


def labelled_findings(rows: DataFrame, most: int = FINDINGS) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels from a bounded sample of distinct texts by hash, about `most` with and without base findings: what `fit` starts from."""
    marked = rows.select("text", F.xxhash64("text").alias("h"), F.col("text").rlike(r"[0-9a-f]{32}|AKIA|(?i:passw|secret|token|api_?key)").alias("some"))
    n = {r["some"]: r["n"] for r in marked.groupBy("some").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = F.when(F.col("some"), min(1.0, most / max(1, n.get(True, 0)))).otherwise(min(1.0, most / max(1, n.get(False, 0))))
    some = marked.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share)
    got = _findings(some).toPandas().sort_values("h")
    return _unpacked(list(got["x"]), list(got["y"]))


def fit(rows: DataFrame, recall: float = RECALL, shards: int = SHARDS) -> Network:
    """rows: text. The network of all distinct texts: from the start that a sample gives, each shard of their findings trains on, in order of
    the texts' hashes; the mean of the shards is calibrated on the findings of every HELD-th text. What comes to the driver are one
    network a shard and counts of logits, so the result depends on the texts only."""
    start = train(*labelled_findings(rows), recall)
    if not start.out.any():
        return start  # nothing to learn from
    found = written(_findings(rows.select("text", F.xxhash64("text").alias("h"))), "findings").withColumn("part", F.pmod("h", F.lit(HELD)))
    names = ("embed", "kernel", "bias", "out", "out_bias")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, memory, n = None, start, {}, 0
        xs, ys = [], []

        def step() -> int:
            x, y = _unpacked(xs, ys)
            xs.clear(), ys.clear()
            order = np.random.default_rng(len(y)).permutation(len(y))
            for i in range(0, len(order), 64):
                net.step(x[order[i : i + 64]], y[order[i : i + 64]], 1e-3, memory)
            return len(y)

        def out() -> pa.RecordBatch:
            weights = np.concatenate([np.ravel(getattr(net, name)) for name in names])
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n]), pa.array([pack(weights)])], names=["shard", "n", "weights"])

        for batch in batches:
            for shard, x, y in zip(*[batch.column(c).to_pylist() for c in ("shard", "x", "y")]):
                if shard != now:
                    if now is not None:
                        n += step()
                        yield out()
                    now, net, memory, n = shard, replace(start), {}, 0
                xs.append(x)
                ys.append(y)
                if len(xs) == TEXTS:
                    n += step()
        if now is not None:
            n += step()
            yield out()

    dealt = found.where("part <> 0").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    got = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h").mapInArrow(learn, "shard long, n long, weights binary").toPandas().sort_values("shard")
    got = got[got["n"] > 0]
    if not len(got):
        return start
    mean = np.average([np.frombuffer(w) for w in got["weights"]], axis=0, weights=got["n"])
    net, at = replace(start), 0
    for name in names:
        own = np.asarray(getattr(start, name))
        setattr(net, name, mean[at : at + own.size].reshape(own.shape) if own.ndim else float(mean[at]))
        at += own.size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                x, y = _unpacked(batch.column("x").slice(s, 256).to_pylist(), batch.column("y").slice(s, 256).to_pylist())
                z = np.floor(net.logits(x) * LOGIT).astype(np.int64)
                (bins, labels), n = np.unique(np.stack([z, y.astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(labels), pa.array(n)], names=["bin", "label", "n"])

    held = found.where("part = 0").mapInArrow(judge, "bin long, label long, n long").groupBy("bin", "label").agg(F.sum("n").alias("n")).toPandas().sort_values(["bin", "label"])
    if held["label"].nunique() < 2:
        return net
    z, sign, n = held["bin"].to_numpy() / LOGIT, 2 * held["label"].to_numpy() - 1, held["n"].to_numpy()
    temps = np.geomspace(0.5, 8, 25)
    net.temperature = float(temps[int(np.argmin([(n * np.logaddexp(0, -sign * z / t)).sum() for t in temps]))])
    good = sign > 0
    below = np.cumsum(n[good])
    net.threshold = float(net.probability(z[good][np.searchsorted(below, (1 - recall) * below[-1], side="right")]))
    return net


def find_secrets(docs: DataFrame, network: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base, score>> for every row of `docs`, in order of start, then kind.

    Null and empty texts have no span. Rows are independent: repeated rows repeat, null ids stay, an empty table stays
    empty, other columns are left out. Places are code points, ends exclusive.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("word", F.col("text").rlike(r"(?i:passw|secret|token|api_?key)|AKIA"))
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def judge(found: list[tuple], read: list[list[int]], last: list[int], out: list[list[dict]]) -> None:
        z = np.concatenate([[0.0], np.cumsum(network.logits(np.array(read, np.int64).reshape(-1, WIDTH)))])
        first = [0, *last[:-1]]
        for (i, s, k, e), a, b in zip(found, first, last):
            p = float(network.probability((z[b] - z[a]) / (b - a)))
            if k < 3 or p >= network.threshold:
                out[i].append({"kind": KINDS[k], "start": s, "end": e, "base": k < 3, "score": p})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            data, bounds = string_bytes(part.column("text"))
            read = part.column("word").to_numpy(zero_copy_only=False).astype(bool)
            if len(data):
                read = read | worth_reading(data, bounds)
            out: list[list[dict]] = [[] for _ in range(part.num_rows)]
            found, read_, last = [], [], []
            for i in np.flatnonzero(read).tolist():
                t = part.column("text")[i].as_py()
                base = base_spans(t)
                for s, k, e in sorted(base + other_candidates(t, base)):
                    found.append((i, s, k, e))
                    read_ += windows(t, s, e)
                    last.append(len(read_))
                    if len(read_) >= _BATCH:
                        judge(found, read_, last, out)
                        found, read_, last = [], [], []
            judge(found, read_, last, out)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(struct))], names=["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return digest(find_secrets(docs, fit(rows)))
