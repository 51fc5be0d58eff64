"""Helpers shared by the text operators: byte-level word hashing, Arrow steps, packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.plans.tables import shared_dir, written  # noqa: F401

#: Text bytes that one step of a numpy operator looks at; a longer single text is one step of its own.
STEP_BYTES = 2_000_000
#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: What the names of an operator's own passing columns begin with: no column of an input clashes with them.
OWN = "__placewright_"
ROW = f"{OWN}row"


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def plain(text: Column | str) -> Column:
    """How texts are compared: lower case, with blanks for everything but letters, digits and marks. Texts of ASCII alone
    are left to plain_bytes, which reads them so; a column that goes elsewhere needs it too."""
    t = F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(""))
    other = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\p{M}]+", " ")
    return F.when(F.octet_length(t) == F.char_length(t), t).otherwise(other)


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def row_key(*cols: Column) -> Column:
    """One 64-bit key for a row; rows equal in all of `cols` share it, and so count as one row repeated."""
    return F.xxhash64(*cols)


# ---- word hashing over the bytes of an Arrow column -------------------------------------------------

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: A value for each byte; the table of word hashes reads A-Z as a-z.
BYTE_TABLE = _TABLE.copy()
_TABLE[65:91] = _TABLE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES)
        out = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    a = a ^ (a >> np.uint64(33))
    a *= np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(33)
    a *= np.uint64(0xC4CEB9FE1A85EC53)
    a ^= a >> np.uint64(33)
    return a


def word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in `data` (uint8), A-Z read as a-z unless `table` differs.

    bounds: n + 1 offsets of the texts. Returns the hashes and, for each text, where its words start (n + 1 values).
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    power, inverse = _power_tables(n + 1)
    word = ~_IS_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power[:n], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, bounds)


def range_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the sequences of words [low, high); equal sequences have equal ones wherever they stand."""
    power, inverse = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[high] - total[low]) * inverse[low] + (high - low).astype(np.uint64))


def hash_word(word: str) -> np.uint64:
    """The hash that word_hashes gives this one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0][0]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets from 0; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off - off[0]


_PLAIN_BYTES = np.full(256, 32, np.uint8)
_PLAIN_BYTES[128:] = np.arange(128, 256)
for _c in range(128):
    if chr(_c).isalnum():
        _PLAIN_BYTES[_c] = ord(chr(_c).lower())


def plain_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """string_bytes of a column of plain(): ASCII in lower case, blanks for its other characters."""
    data, bounds = string_bytes(column)
    return _PLAIN_BYTES[data], bounds


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `most` text bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, bounds = string_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def by_group(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, one table at a time; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(c[s] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


_MULT = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Index of uint64 keys in a fixed set by open addressing; -1 where absent."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4)))))
        size = 1 << int(64 - int(self.shift))
        self.keys, self.at = np.full(size + 64, 2**64 - 1, np.uint64), np.full(size + 64, -1, np.int32)
        slot = ((keys * _MULT) >> self.shift).astype(np.int64)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            s = slot[todo] + self.probes
            free = self.at[s] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, s, -1), return_index=True)[1]] = True
            put = first & free
            self.keys[s[put]], self.at[s[put]] = keys[todo[put]], todo[put]
            todo = todo[~put]
            self.probes += 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys * _MULT) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        for p in range(1, self.probes):
            miss = np.flatnonzero((out < 0) & (self.at[slot + p - 1] >= 0)) if p == 1 else miss[out[miss] < 0]
            if not len(miss):
                break
            s = slot[miss] + p
            out[miss] = np.where(self.keys[s] == keys[miss], self.at[s], -1)
        return out
