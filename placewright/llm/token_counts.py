"""Operator 4, token counts: byte-pair merging with a heap over a linked list of symbols; no identifiers are made.

A word of m initial symbols ends with m minus (merges done) tokens. The vocabulary file gives the merge ranks and the
pre-tokenizer pattern; the text rules (NFC, white space, lower case) are those of the file.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of each of a worker's two caches, some 30 MB; a full cache is emptied, and both are at the end of a task.
CACHE_WORDS = 200_000


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable bytes stand for themselves, the
    others take code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeRules:
    """Merge ranks over small integer symbols. pair key: left * size + right -> (rank, merged symbol)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        signs = byte_symbols()
        self.inner = [number(s) for s in signs]
        self.last = [number(s + self.end) for s in signs]
        triples = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            triples.append((number(a), number(b), number(a + b)))
        self.size = len(names)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b, c) in enumerate(triples):
            self.pairs.setdefault(a * self.size + b, (rank, c))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        specials = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(specials)) if specials else None

    def count(self, word: bytes) -> int:
        """Tokens of one pre-tokenized word: pop the lowest-ranked adjacent pair until none is left."""
        n = len(word)
        if n < 2:
            return n
        pairs, size = self.pairs, self.size
        sym = [self.inner[b] for b in word]
        sym[-1] = self.last[word[-1]]
        heap = []
        for i in range(n - 1):
            hit = pairs.get(sym[i] * size + sym[i + 1])
            if hit is not None:
                heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens = n
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two has gone or changed since the pair was pushed
            sym[i], sym[j] = merged, -1
            k = after[i] = after[j]
            tokens -= 1
            if k < n:
                before[k] = i
                hit = pairs.get(merged * size + sym[k])
                if hit is not None:
                    heapq.heappush(heap, (hit[0], i, merged, sym[k], hit[1]))
            p = before[i]
            if p >= 0:
                hit = pairs.get(sym[p] * size + merged)
                if hit is not None:
                    heapq.heappush(heap, (hit[0], p, sym[p], merged, hit[1]))
        return tokens


_loaded: dict[str, tuple[MergeRules, dict[str, int], dict[str, int]]] = {}


def rules_of(path: str) -> tuple[MergeRules, dict[str, int], dict[str, int]]:
    """The rules of a file, and a worker's caches of the counts of chunks and of pieces."""
    if path not in _loaded:
        _loaded[path] = (MergeRules(path), {}, {})
    return _loaded[path]


#: Lower case of letters that Unicode took in after version 15.1, the one of Python's tables; fixed values.
NEWER_CASE = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_NEWER = re.compile(f"[{''.join(map(chr, NEWER_CASE))}]")


def normalise(text: str) -> str:
    """NFC, then lower case; white space only separates pieces, so it needs no rewriting.

    Lower case is taken one character at a time, as the file's normaliser does: a final capital sigma becomes σ.
    """
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if _NEWER.search(text):
        text = text.translate(NEWER_CASE)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def count_text(text: str, rules: MergeRules, chunks: dict[str, int], pieces: dict[str, int]) -> int:
    if rules.specials is not None and "<|" in text:
        total, at = 0, 0  # a special string inside a text is one token, and ends what stands before it
        for m in rules.specials.finditer(text):
            total += 1 + _count_plain(text[at : m.start()], rules, chunks, pieces)
            at = m.end()
        return total + _count_plain(text[at:], rules, chunks, pieces)
    return _count_plain(text, rules, chunks, pieces)


def _count_plain(text: str, rules: MergeRules, chunks: dict[str, int], pieces: dict[str, int]) -> int:
    """No piece holds a blank or a line end, so the chunks between them are counted one by one, from a cache if seen."""
    words = normalise(text).replace("\n", " ").split(" ")
    found = list(map(chunks.get, words))
    if None in found:
        for i, n in enumerate(found):
            if n is None:
                w = words[i]
                n = found[i] = chunks.get(w)
                if n is None:
                    n = found[i] = sum(_count_piece(p, rules, pieces) for p in rules.pieces.findall(w))
                    _keep(chunks, w, n)
    return sum(found)


def _count_piece(piece: str, rules: MergeRules, pieces: dict[str, int]) -> int:
    n = pieces.get(piece)
    if n is None:
        n = rules.count(piece.encode())
        _keep(pieces, piece, n)
    return n


def _keep(cache: dict[str, int], word: str, n: int) -> None:
    if len(word) <= 64:
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        cache[word] = n


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`, in one pass without a shuffle.

    vocabulary: path of a byte-pair vocabulary (.json) that every executor has. Null and empty texts have 0 tokens, a
    null doc_id stays null, repeated rows repeat, other columns are left out whatever their names, an empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, chunks, pieces = rules_of(vocabulary)
        try:
            for batch in batches:
                for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    yield counted(part, rules, chunks, pieces)
        finally:
            chunks.clear()
            pieces.clear()

    def counted(part: pa.RecordBatch, rules: MergeRules, chunks: dict[str, int], pieces: dict[str, int]) -> pa.RecordBatch:
        texts = part.column("text")
        n_bytes = pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], pa.int64())
        n_tokens = pa.array([count_text(t, rules, chunks, pieces) if t else 0 for t in texts.to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, n_tokens], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
