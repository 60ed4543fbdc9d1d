"""Vectorised kernels over Arrow string columns: words, hashes, shingles, and the recompression parse.

Everything here works on one bounded slice of a column at a time and is called from inside Spark tasks.
"""

from __future__ import annotations

import ctypes
import os
import secrets
from collections.abc import Iterator
from contextlib import suppress
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95


def one_thread() -> None:
    """The tokenizers library takes as many threads as the machine has, each with memory of its own; a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def release() -> None:
    """Give freed memory of this Python worker back to the machine: a reused worker would keep it beside the next stage."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(kernel, tables: int = 1):
    """A grouped kernel of one or two tables that gives its memory back after each group."""

    def of_one(table: pa.Table) -> pa.Table:
        out = kernel(table)
        release()
        return out

    def of_two(table: pa.Table, other: pa.Table) -> pa.Table:
        out = kernel(table, other)
        release()
        return out

    return of_one if tables == 1 else of_two


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Spans longer than this are hashed one by one.
LONG_SPAN = 64


def random_key() -> int:
    """A key for word_hashes() that nobody can know before the run; draw it once for all tasks that compare hashes."""
    return secrets.randbits(63) | 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, key: int = 0) -> np.ndarray:
    """Hash of the bytes of each span; with fold, A-Z count as a-z.

    Eight bytes a step, each step passed through mix. Without a key the steps can be undone, so spans with equal hashes can
    be computed: that will do where a hash only deals rows out or narrows them down. With a key of random_key() the state
    before the first step is unknown, and unequal spans meet by chance alone (2**-64 a pair).
    """
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = _FOLD[raw] if fold else raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = left.astype(U64) * U64(_P)
    if key:
        out = mix(out ^ U64(key))
    todo, at = np.flatnonzero((left > 0) & (left <= LONG_SPAN)), starts
    at, left = starts[todo], left[todo]
    while len(todo):
        out[todo] = mix(out[todo] * U64(_Q) + (eight[at] & _KEPT[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for n in np.flatnonzero(ends - starts > LONG_SPAN):
        out[n] = int.from_bytes(blake2b(padded[starts[n] : ends[n]], digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "little")
    return out


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, keys: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of each span, which together tell spans apart: spans of up to eight bytes always, for a step is a
    bijection of them, longer ones by two hashes with random keys (2**-127 a pair). No key is 0."""
    value = word_hashes(raw, starts, ends, fold, keys[0])
    check = (ends - starts).astype(U64) << U64(1) | value & U64(1)
    long = np.flatnonzero(ends - starts > 8)
    if len(long):
        check[long] = word_hashes(raw, starts[long], ends[long], fold, keys[1])
    return value | U64(1), check


def distinct_of(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct (key, check), and the number of each place's."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return order[fresh], back


class Runs:
    """Hashes of runs of at most `most` words from those of 1, 2, 4 .. words, which each hash two of the one before."""

    def __init__(self, value: np.ndarray, most: int):
        self.powers = [value]
        for j in range(max(most, 1).bit_length() - 1):
            last, step = self.powers[-1], 1 << j
            out = last * U64(_Q)
            out[:-step or None] += last[step:]
            self.powers.append(mix(out))

    def of(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """The hash of the `size` words from each start on."""
        out = np.zeros(len(starts), U64) + np.asarray(size).astype(U64) * U64(_P)
        at = starts.copy()
        for j in range(len(self.powers) - 1, -1, -1):
            has = np.broadcast_to(np.asarray(size) >> j & 1 > 0, at.shape)
            if not has.any():
                continue
            use = slice(None) if has.all() else has
            out[use] = mix(out[use] * U64(_Q) + self.powers[j][at[use]])
            at[use] += 1 << j
        return out


def column_slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row in them) for runs of rows of about limit bytes; nulls are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        kind = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, kind, len(chunk) + 1, chunk.offset * kind().itemsize).astype(np.int64) if len(chunk) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield base + i, base + j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        base += len(chunk)


class Words:
    """The words of one slice: hash and byte span of each, its row, and each row's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool = False, key: int = 0):
        rows = len(offsets) - 1
        gap = _SPACE[raw]
        begin = ~gap
        begin[1:] &= gap[:-1] | False
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[heads] = ~gap[heads]
        end = ~gap
        if len(raw):
            end[:-1] &= gap[1:]
            tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            end[tails] = ~gap[tails]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        self.hash = word_hashes(raw, self.starts, self.ends, fold, key)

    def __len__(self) -> int:
        return len(self.starts)


def windows(words: Words, k: int, runs: Runs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of k words that lies in one row."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    starts = np.flatnonzero(words.row[: n - k + 1] == words.row[k - 1 :])
    return starts, (runs or Runs(words.hash, k)).of(starts, k)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct k-word shingles, sorted by both; a shorter row's whole sequence is its only one."""
    runs = Runs(words.hash, k)
    starts, value = windows(words, k, runs)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    row = np.concatenate([words.row[starts], short])
    value = np.concatenate([value, runs.of(words.first[short], counts[short])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
        row, value = row[fresh], value[fresh]
    return row, value


class Symbols:
    """The symbols left of one row after another: name, first word, row; and the words left:right that decide each symbol
    (the same words elsewhere give the same symbol there), or None once no symbol is decided by few words."""

    __slots__ = ("name", "start", "row", "left", "right", "fresh")

    def __init__(self, name, start, row, left=None, right=None):
        self.name, self.start, self.row, self.left, self.right = name, start, row, left, right
        self.fresh = np.ones(len(name), bool)

    def take(self, at: np.ndarray) -> None:
        for k in self.__slots__:
            if getattr(self, k) is not None:
                setattr(self, k, getattr(self, k)[at])


_EDGE = np.int32(2**31 - 1)


def _before(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[head] = -_EDGE
    return out


def _after(x: np.ndarray, tail: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[:-1] = x[1:]
    out[tail] = _EDGE
    return out


def _name_round(s: Symbols, salt: int) -> None:
    """One round: maximal runs of a name become one symbol each, then each left symbol with a right one after it.

    A run is maximal only beside its neighbours, so the nearest symbol of each of them decides it too, but not how far a
    neighbour's own run goes on; left and right are bits of the names.
    """
    near_left, near_right = s.left, s.right
    s.fresh = np.zeros(len(s.name), bool)
    with_next = s.row[1:] == s.row[:-1]
    equal = with_next & (s.name[1:] == s.name[:-1])
    if equal.any():
        first = np.flatnonzero(np.concatenate([[True], ~equal]))
        length = np.diff(np.concatenate([first, [len(s.name)]]))
        if s.left is not None:
            near_left, near_right = s.left[first + length - 1], s.right[first]
        s.take(first)
        many = length > 1
        s.name[many] = mix(s.name[many] * U64(_Q) + length[many].astype(U64) * U64(_P) + U64(salt))
        s.fresh = many
        with_next = s.row[1:] == s.row[:-1]
    is_left = s.name * (mix(np.array([salt], U64)) | U64(1)) >> U64(63) == 0
    if s.left is not None:
        head, tail = np.concatenate([[True], ~with_next]), np.concatenate([~with_next, [True]])
        left, right = _before(near_left, head), _after(near_right, tail)
        s.left, s.right = np.where(is_left, left, _before(left, head)), np.where(is_left, _after(right, tail), right)
    pair = np.flatnonzero(is_left[:-1] & ~is_left[1:] & with_next)
    s.name[pair] = mix(s.name[pair] * U64(_Q) + s.name[pair + 1] * U64(_P) + U64(salt + 1))
    s.fresh[pair] = True
    keep = np.ones(len(s.name), bool)
    keep[pair + 1] = False
    s.take(np.flatnonzero(keep))


def rounds_of(words: Words, decided_by: int) -> Iterator[Symbols]:
    """Recompression to the end: rounds until every row is one symbol. left and right are kept while some symbol is
    decided by at most so many words."""
    here = np.arange(len(words), dtype=np.int32)
    s, salt = Symbols(words.hash.copy(), here, words.row.astype(np.int32), here, here + np.int32(1)), 1000
    if not decided_by:
        s.left = s.right = None
    while len(s.name):
        _name_round(s, salt)
        yield s
        if s.left is not None and not ((s.left >= 0) & (s.right < _EDGE) & (s.right - np.maximum(s.left, 0) <= decided_by)).any():
            s.left = s.right = None
        several = s.row[1:] == s.row[:-1]
        s.take(np.flatnonzero(np.concatenate([[False], several]) | np.concatenate([several, [False]])))
        salt += 17


def recompressed(words: Words, k: int, least: int, with_anchors: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(each word's anchor key as the first of a k-word window; starts, ends and names of symbols of `least` words or more).

    A window's anchor is, among the symbols of all rounds that the window's own words decide, the one decided by the most
    words (ties: the largest key). So equal windows, wherever they stand, have equal anchors. Places that begin no window
    have keys of no meaning.
    """
    n = len(words)
    best = np.zeros(n if with_anchors else 0, U64)
    runs = Runs(words.hash, k) if with_anchors else None
    begin, end, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for r, s in enumerate(rounds_of(words, k if with_anchors else 0)):
        stop = np.append(s.start[1:], np.int32(n))
        last = np.flatnonzero(np.append(s.row[1:] != s.row[:-1], True))
        stop[last] = words.first[s.row[last] + 1]
        big = np.flatnonzero(s.fresh & (stop - s.start >= least))
        begin.append(s.start[big].astype(np.int64))
        end.append(stop[big].astype(np.int64))
        names.append(s.name[big])
        if s.left is None:
            continue
        ok = np.flatnonzero((s.left >= 0) & (s.right < _EDGE) & (s.right - np.maximum(s.left, 0) <= k))
        a, size = s.left[ok], s.right[ok] - s.left[ok]
        key = mix(runs.of(a, size) ^ mix(s.name[ok] + U64(r)))
        key = (size.astype(U64) << U64(59)) | (key >> U64(5))
        for back in range(k - 1):
            fits = (size + back <= k) & (a >= back)
            np.maximum.at(best, a[fits] - back, key[fits])
    bare = np.flatnonzero(best[: max(n - k + 1, 0)] == 0)
    if len(bare):
        single = (U64(1) << U64(59)) | (mix(words.hash) >> U64(5))
        best[bare] = np.max([single[bare + j] for j in range(k)], axis=0)
    return best, np.concatenate(begin), np.concatenate(end), np.concatenate(names)
