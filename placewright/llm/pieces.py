"""Operator 2, SentencePiece encoding and decoding with N-best segmentation.

A text, with a blank put before it and blanks as the mark of the vocabulary, is a lattice: nodes are the places between
characters, edges are pieces with their scores. No piece has a mark after another character, so every best path goes
through the places before the marks and the lattice falls into segments, most of them words.

Forward: Viterbi gives each node the score of the best way to it, and of the second best; it runs on all new segments of
a step at once, by length. Backward: A-star goes from the end of a segment to its start; the forward scores are exact
heuristics, so paths leave the agenda in order of their total scores and no path is opened in vain. The N best of a text
are the N best sums over its segments; only the N - 1 segments with the least loss for their second path can differ.
A character without a piece becomes its UTF-8 bytes' pieces, at a score below any other piece.

The scores in the model file are merge ranks, not log probabilities: their sums favour many early merges. A piece's score
here is the log probability that Zipf's law gives its rank, log(1 / (rank + ZIPF_SHIFT)) less the log of the sum over all
pieces. Nothing is trained.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, Lookup, mix, steps

MARK = "▁"
TEXT, IDS = f"{OWN}text", f"{OWN}ids"
N_BEST = 3
#: Segments, and segments with their N best, that a worker remembers, some 64 MB in all; a full memory is emptied, and all
#: is forgotten at the end of a task.
CACHE_SEGMENTS, CACHE_WAYS = 300_000, 20_000
#: Added to the rank of a piece in Zipf's law.
ZIPF_SHIFT = 50.0
#: As many segments of one length make a numpy step worthwhile.
_TOGETHER = 8
_SEGMENT = re.compile(r" *[^ ]+| +$")
_PRIME = np.uint64(0x100000001B3)


class Vocabulary:
    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [p.encode() for p in self.names]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = np.full(n, -np.inf)
        rank = np.argsort([-sp.get_score(i) for i in plain], kind="stable")
        share = 1 / (np.arange(len(plain)) + ZIPF_SHIFT)
        self.score[np.array(plain)[rank]] = np.log(share / share.sum())
        self.longest = max(len(p) for p in self.ids)
        self.unknown = float(self.score[plain].min()) - 10.0
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark inside: texts don't fall into segments at marks")
        # The tree of all beginnings of pieces: the piece that each one is (-1: none), and whether one goes on from it.
        starts = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)})
        goes_on = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.find = Lookup(np.array([self._hash(p) for p in starts], np.uint64))
        self.piece_of = np.array([self.ids.get(p, -1) for p in starts], np.int32)
        self.goes_on = np.array([p in goes_on for p in starts])
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[ord(p) for p in starts if len(p) == 1]] = [i for i, p in enumerate(starts) if len(p) == 1]
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.ids if len(p) == 1]] = True
        self.index: dict[str, int] = {}
        self.clear()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_PRIME) + ord(c) + 1) % 2**64
        return int(mix(np.array([h], np.uint64))[0])

    def clear(self) -> None:
        """Forget all segments. Arrays by segment: best and second score, first place of its ids in `flat` and number."""
        self.index.clear()
        self.best, self.second = np.zeros(0), np.zeros(0)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.nbest_of: dict[tuple[str, int], list] = {}

    # -- one segment

    def edges(self, s: str, end: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the pieces that end at `end`, longest first."""
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(s[start:end])
            if i is not None:
                yield start, self.score[i], (i,)
        if not self.single[ord(s[end - 1])]:
            yield end - 1, self.unknown, tuple(self.byte_ids[b] for b in s[end - 1].encode())

    def forward(self, s: str) -> tuple[list[float], list[float], list]:
        """Best and second score of every node, and the edge by which the best comes."""
        best, second, back = [0.0], [-np.inf], [None]
        for end in range(1, len(s) + 1):
            a = b = -np.inf
            edge = None
            for start, score, ids in self.edges(s, end):
                x, y = best[start] + score, second[start] + score
                if x > a:
                    a, b, edge = x, max(a, y), (start, ids)
                else:
                    b = max(b, x)
            best.append(a)
            second.append(b)
            back.append(edge)
        return best, second, back

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a segment in order: backward A-star with forward scores as the heuristic."""
        best = self.forward(s)[0]
        agenda = [(-best[len(s)], 0, len(s), 0.0, ())]
        out, serial = [], 1
        while agenda and len(out) < n:
            total, _, at, done, ids = heapq.heappop(agenda)
            if at == 0:
                out.append((-total, ids))
                continue
            for start, score, own in self.edges(s, at):
                heapq.heappush(agenda, (-(best[start] + score + done), serial, start, score + done, own + ids))
                serial += 1
        return out

    # -- many segments

    def learn(self, segments: list[str]) -> None:
        """Segment what isn't known yet. Segments are given without their first mark, blanks standing for marks."""
        if len(self.index) + len(segments) > CACHE_SEGMENTS:
            self.clear()
        groups: dict[int, list[str]] = {}
        for s in segments:
            groups.setdefault(len(s) + 1, []).append(s)
        names, best, second, sizes, flats = [], [], [], [], []
        for length, group in groups.items():
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                texts = [MARK + s.replace(" ", MARK) for s in some]
                if len(some) < _TOGETHER:
                    found = [self._one(t) for t in texts]
                    b, c, n, ids = ([f[i] for f in found] for i in range(4))
                    ids = np.fromiter((i for x in ids for i in x), np.int32)
                else:
                    b, c, n, ids = self._together(texts, length)
                names += some
                best.append(np.asarray(b, np.float64))
                second.append(np.asarray(c, np.float64))
                sizes.append(np.asarray(n, np.int64))
                flats.append(ids)
        base = len(self.best)
        size = np.concatenate(sizes)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.best, self.second = np.concatenate([self.best, *best]), np.concatenate([self.second, *second])
        self.flat = np.concatenate([self.flat, *flats])
        self.index.update(zip(names, range(base, base + len(names))))

    def _one(self, s: str) -> tuple[float, float, int, list[int]]:
        best, second, back = self.forward(s)
        ids: list[int] = []
        at = len(s)
        while at:
            at, own = back[at]
            ids[:0] = own
        return best[-1], second[-1], len(ids), ids

    def _together(self, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        code = np.ascontiguousarray(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(n, length).T)
        wide = code.astype(np.uint64) + np.uint64(1)
        best, second = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        best[0] = 0
        came, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        every = np.arange(n)
        for start in range(length):  # earlier starts have settled best[start]; a start goes down the tree of pieces
            live, row, h = every, self.of_char[code[start]], wide[start]
            for end in range(start + 1, length + 1):
                ids = self.piece_of[row]
                hit = np.flatnonzero((row >= 0) & (ids >= 0))
                if len(hit):
                    at, ids = live[hit], ids[hit]
                    self._offer(best[end], second[end], came[end], piece[end], best[start], second[start], at, self.score[ids], start, ids)
                go = np.flatnonzero((row >= 0) & self.goes_on[row])
                if not len(go) or end == length:
                    break
                live = live[go]
                h = h[go] * _PRIME + wide[end][live]
                row = self.find(mix(h))
            odd = np.flatnonzero(~self.single[code[start]])
            if len(odd):
                end = start + 1
                self._offer(best[end], second[end], came[end], piece[end], best[start], second[start], odd, self.unknown, start, -1)
        # Walk back from the ends, all segments at once; a piece of -1 is a character's bytes.
        owners, ids, starts = [], [], []
        at, live = np.full(n, length), every
        while len(live):
            owners.append(live)
            ids.append(piece[at[live], live])
            starts.append(came[at[live], live])
            at[live] = starts[-1]
            live = live[starts[-1] > 0]
        owner, flat, start = (np.concatenate(x[::-1]) for x in (owners, ids, starts))
        order = np.argsort(owner, kind="stable")
        owner, flat, start = owner[order], flat[order], start[order]
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            own = [[self.byte_ids[x] for x in texts[i][s].encode()] for i, s in zip(owner[odd].tolist(), start[odd].tolist())]
            width = np.ones(len(flat), np.int64)
            width[odd] = [len(x) for x in own]
            owner, flat = np.repeat(owner, width), np.repeat(flat, width)
            flat[flat < 0] = [i for x in own for i in x]
        return best[length], second[length], np.bincount(owner, minlength=n), flat.astype(np.int32)

    @staticmethod
    def _offer(a, b, came, piece, best, second, hit, score, start, ids) -> None:  # noqa: ANN001
        x, y = best[hit] + score, second[hit] + score
        old, old_second = a[hit], b[hit]
        up = x > old
        b[hit] = np.where(up, np.maximum(old, y), np.maximum(old_second, x))
        a[hit] = np.where(up, x, old)
        at = hit[up]
        came[at] = start
        piece[at] = ids[up] if isinstance(ids, np.ndarray) else ids

    # -- texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(segment numbers of all texts, where each text starts, their segments)."""
        split = [segments(t) for t in texts]
        flat = [s for x in split for s in x]
        missing = {s for s in flat if s not in self.index}
        if missing:
            if len(self.index) + len(missing) > CACHE_SEGMENTS:
                missing = set(flat)
            self.learn(list(missing))
        starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        return np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat)), starts, flat

    def ids_of(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.first[numbers], size)
        return self.flat[place], np.concatenate([[0], ends])[starts]

    def alternatives(self, flat: list[str], numbers: np.ndarray, lo: int, hi: int, n: int) -> list[tuple[float, tuple]]:
        """The n best of the text whose segments are lo..hi: (loss, ((place, ids), ...)), the best first."""
        own = numbers[lo:hi]
        loss = self.best[own] - self.second[own]
        k = min(n - 1, len(own))
        if k <= 0:
            return [(0.0, ())]
        some = np.argpartition(loss, k - 1)[:k] if k < len(own) else np.arange(len(own))
        out: list[tuple[float, tuple]] = [(0.0, ())]
        for i in sorted(some.tolist()):
            s = flat[lo + i]
            ways = self.nbest_of.get((s, n))
            if ways is None:
                ways = self.nbest_of[s, n] = self.nbest(MARK + s.replace(" ", MARK), n)
                if len(self.nbest_of) > CACHE_WAYS:
                    self.nbest_of.clear()
            top = ways[0][0]
            both = [(x + top - score, change if j == 0 else (*change, (i, ids))) for x, change in out for j, (score, ids) in enumerate(ways)]
            out = heapq.nsmallest(n, both, key=lambda z: z[0])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; runs of byte pieces are read as UTF-8."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def segments(text: str) -> list[str]:
    """The segments of a text, each without its first mark; none for an empty text."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [s[1:] for s in _SEGMENT.findall(" " + text)]
    return text.split(" ")


_loaded: dict[str, Vocabulary] = {}


def vocabulary_of(model: str) -> Vocabulary:
    if model not in _loaded:
        _loaded[model] = Vocabulary(model)
    return _loaded[model]


def encode(docs: DataFrame, model: str, n_best: int = N_BEST, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` and: ids, score, n_best, round_trip.

    ids: the best segmentation; n_best: array<struct<score, changes>> of the n best, `changes` being the segments that
    differ from the best with their ids; round_trip: whether decoding ids gives the text (the mark character itself is
    read as a blank). Null and empty texts have no ids, score 0 and one segmentation, the empty one. Equal scores are in
    order of the agenda. Rows are independent; an empty table stays empty; other columns are left out.
    """
    keep = keep if keep is not None else ["doc_id"]
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(TEXT))
    ways = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("segment", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        try:
            for part in steps(batches, TEXT, 1_000_000):
                yield encoded(part, vocabulary)
        finally:
            vocabulary.clear()

    def encoded(part: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
        texts = part.column(TEXT).to_pylist()
        numbers, starts, flat = vocabulary.encode(texts)
        ids, cuts = vocabulary.ids_of(numbers, starts)
        score = np.add.reduceat(np.append(vocabulary.best[numbers], 0.0), np.minimum(starts[:-1], len(numbers))) * (np.diff(starts) > 0)
        some, good = [], []
        for i, t in enumerate(texts):
            best = vocabulary.alternatives(flat, numbers, starts[i], starts[i + 1], n_best)
            some.append([{"score": score[i] - x, "changes": [{"segment": p, "ids": q} for p, q in c]} for x, c in best])
            good.append(vocabulary.decode(ids[cuts[i] : cuts[i + 1]].tolist()) == t.replace(MARK, " "))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(score), pa.array(some, ways), pa.array(good)], names=[*keep, "ids", "score", "n_best", "round_trip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{kinds}, ids array<int>, score double, n_best array<struct<score:double,changes:array<struct<segment:int,ids:array<int>>>>>, round_trip boolean")


def decode(rows: DataFrame, model: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `rows` and `text`, decoded from the list of ids; null lists give null."""
    keep = keep if keep is not None else ["doc_id"]
    some = rows.select(*keep, F.col(ids).alias(IDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [None if x is None else vocabulary.decode(x) for x in part.column(IDS).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[: len(keep)])
    return some.mapInArrow(run, f"{kinds}, text string")


def digest(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns `more`, and what the encoding comes to: n_pieces, score, second_score, n_ways, ids_sum,
    round_trip."""
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + x, F.lit(2_147_483_647)))
    return encoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_pieces"), "score", F.get("n_best", F.lit(1))["score"].alias("second_score"),
        F.size("n_best").alias("n_ways"), total.alias("ids_sum"), "round_trip",
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(encode(docs, public_tokenizers.path("piece_bpe_32k.model")), "ids", "n_best")
