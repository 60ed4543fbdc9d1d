"""Edit-aware token counts.

A document is cut before white space and after it where no pre-token of the tokenizer can reach across, into leaves that
are counted on their own. A segment tree over blocks of leaves keeps the sums. An edit cuts and counts again only the
leaves that it touches and one more on either side, then updates the sums above them; all other leaves keep their counts.

Leaves of many documents are found, hashed and looked up as whole arrays; a block's leaves become strings only when an
edit opens it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import column_slices, distinct_of, one_thread, random_key, release, word_keys
from .packing import WordTable

#: Words in one call of the tokenizer.
JOINED = 512
#: Distinct leaves whose counts are kept, and those of edits.
CACHED, CACHED_EDITS = 400_000, 20_000
#: The characters of Unicode's White_Space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A leaf: white space before the last white character of a run, a word with one space before it, or other white space.
_LEAF = re.compile(f"[{_WHITE}]+(?=[{_WHITE}][^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]+")
_ASCII_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])
_LONG_WHITE = {c.encode() for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{_WHITE}]", c)}
_LONG_LEAD = np.isin(np.arange(256), [w[0] for w in _LONG_WHITE])
_LONG_CODES = {n: np.array([int.from_bytes(w, "big") for w in _LONG_WHITE if len(w) == n]) for n in (2, 3)}


def leaves_of(text: str) -> list[str]:
    """The text in leaves. Their pre-tokens, put one after another, are the text's."""
    return _LEAF.findall(text)


def leaf_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the leaves of UTF-8 texts begin, sorted; each ends where the next begins."""
    white, size = _ASCII_WHITE[raw], np.ones(len(raw), np.int8)
    lead = np.flatnonzero(_LONG_LEAD[raw]) if (raw >= 0x80).any() else ()
    for n in (2, 3) if len(lead) else ():
        at = lead[lead + n <= len(raw)]
        found = at[np.isin(sum(raw[at + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n)), _LONG_CODES[n])]
        for k in range(n):
            white[found + k] = True
        size[found + n - 1] = n
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    turn = np.zeros(len(raw), bool)
    turn[1:] = white[1:] != white[:-1]
    turn[heads] = True
    runs = np.flatnonzero(turn)
    words = runs[~white[runs]]
    after = words[white[words - 1] & (words > 0)]
    after = after[~np.isin(after, heads)] if len(after) else after
    spaced = raw[after - 1] == 0x20
    # A word takes the one space before it; other white characters before a word are leaves of their own.
    turn[after[spaced]] = False
    turn[after[spaced] - 1] = True
    other = after[~spaced]
    turn[other - size[other - 1]] = True
    return np.flatnonzero(turn)


class Counter:
    """Token counts of leaves, each distinct leaf encoded once while it is cached."""

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.table, self.known, self.keys = WordTable(16), {}, (random_key(), random_key())
        self.line_feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, leaves: list[str]) -> list[int]:
        """Words are encoded many in one text, a line feed between them: a leaf by itself, with a token of its own."""
        words = np.array([x[-1:].strip() != "" for x in leaves], bool) if len(self.line_feed) == 1 else np.zeros(len(leaves), bool)
        out = np.zeros(len(leaves), np.int32)
        at = np.flatnonzero(words)
        groups = [at[a : a + JOINED] for a in range(0, len(at), JOINED)]
        for group, ids in zip(groups, self._ids(["\n".join(leaves[k] for k in g) for g in groups]), strict=True):
            ends = np.flatnonzero(np.array(ids) == self.line_feed[0])
            if len(ends) == len(group) - 1:
                out[group] = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            else:
                words[group] = False
        other = np.flatnonzero(~words)
        out[other] = [len(ids) for ids in self._ids([leaves[k] for k in other])]
        return out.tolist()

    def of_spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, checks = word_keys(raw, starts, ends, False, self.keys)
        found = self.table.find(keys, checks)
        new = np.flatnonzero(found < 0)
        if len(new):
            first, back = distinct_of(keys[new], checks[new])
            at = new[first]
            counts = np.array(self._encoded([raw[starts[k] : ends[k]].tobytes().decode() for k in at]), np.int32)
            if self.table.size + len(at) > CACHED:
                self.table = WordTable(16)
            self.table.add(keys[at], checks[at], counts)
            found[new] = counts[back]
        return found

    def counts(self, leaves: list[str]) -> list[int]:
        new = list({x for x in leaves if x not in self.known})
        if len(self.known) + len(new) > CACHED_EDITS:
            self.known, new = {}, list(set(leaves))
        self.known.update(zip(new, self._encoded(new), strict=True))
        return [self.known[x] for x in leaves]


class SegmentTree:
    """Characters and tokens of blocks of leaves in a tree of sums; replacing leaves rebuilds the sums above them only.

    A block holds WIDTH leaves at first, and is opened (leaves as strings, with their counts) when an edit comes to it.
    """

    WIDTH = 32

    def __init__(self, chars: list[int], tokens: list[int], opened: Callable[[int], tuple[list[str], list[int]]]):
        self.blocks: list = [None] * len(chars) or [([], [])]
        self.opened = opened
        n = 1 << (len(self.blocks) - 1).bit_length()
        self.size = n
        rest = [0] * (n - len(chars))
        self.chars, self.tokens = [0] * n + chars + rest, [0] * n + tokens + rest
        for sums in (self.chars, self.tokens):
            for k in range(n - 1, 0, -1):
                sums[k] = sums[2 * k] + sums[2 * k + 1]

    @classmethod
    def of(cls, leaves: list[str], counts: list[int]) -> SegmentTree:
        cut = [(leaves[a : a + cls.WIDTH], counts[a : a + cls.WIDTH]) for a in range(0, len(leaves), cls.WIDTH)]
        return cls([sum(map(len, x)) for x, _ in cut], [sum(c) for _, c in cut], cut.__getitem__)

    def block(self, k: int) -> tuple[list[str], list[int]]:
        if self.blocks[k] is None:
            self.blocks[k] = self.opened(k)
        return self.blocks[k]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _update(self, block: int) -> None:
        k = self.size + block
        leaves, counts = self.block(block)
        self.chars[k], self.tokens[k] = sum(map(len, leaves)), sum(counts)
        k //= 2
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    def locate(self, char: int) -> tuple[int, int, int]:
        """Block, leaf and the leaf's first character, of the leaf that holds a character (the last leaf at the end)."""
        k, at = 1, 0
        while k < self.size:
            k *= 2
            if char - at >= self.chars[k] and self.chars[k + 1]:
                at += self.chars[k]
                k += 1
        block = k - self.size
        leaves = self.block(block)[0]
        for n, leaf in enumerate(leaves):
            if char < at + len(leaf) or n == len(leaves) - 1:
                return block, n, at
            at += len(leaf)
        return block, 0, at

    def before(self, block: int, leaf: int) -> tuple[int, int]:
        """The place of the leaf before, or the same at the start."""
        if leaf:
            return block, leaf - 1
        while block:
            block -= 1
            if self.block(block)[0]:
                return block, len(self.block(block)[0]) - 1
        return 0, 0

    def edit(self, start: int, end: int, text: str, counter: Counter) -> int:
        """Replace characters start:end; returns how many leaves were encoded again."""
        length = self.chars[1]
        start, end = max(0, min(start, length)), max(0, min(max(start, end), length))
        block, leaf, _ = self.locate(max(start - 1, 0))
        block, leaf = self.before(block, leaf)
        # White space looks at what follows it, so the region begins and ends with leaves that are words.
        while self.block(block)[0] and self.block(block)[0][leaf].isspace() and (block, leaf) != self.before(block, leaf):
            block, leaf = self.before(block, leaf)
        first = sum(len(x) for x in self.block(block)[0][:leaf])
        k = self.size + block
        while k > 1:
            first += self.chars[k - 1] if k % 2 else 0
            k //= 2
        last, stop, at = self.locate(min(end, max(length - 1, 0)))
        while True:
            stop += 1
            while stop >= len(self.block(last)[0]) and last + 1 < len(self.blocks):
                last, stop = last + 1, 0
            if stop >= len(self.block(last)[0]) or not self.block(last)[0][stop].isspace():
                break
        stop += 1
        old = "".join(x for b in range(block, last + 1) for x in self.block(b)[0][leaf if b == block else 0 : stop if b == last else None])
        new = old[: start - first] + text + old[end - first :]
        fresh = leaves_of(new)
        counts = counter.counts(fresh)
        head_l, head_c = self.block(block)[0][:leaf], self.block(block)[1][:leaf]
        tail_l, tail_c = self.block(last)[0][stop:], self.block(last)[1][stop:]
        self.blocks[block] = (head_l + fresh, head_c + counts)
        for b in range(block + 1, last):
            self.blocks[b] = ([], [])
        if last == block:
            self.block(block)[0].extend(tail_l)
            self.block(block)[1].extend(tail_c)
        else:
            self.blocks[last] = (tail_l, tail_c)
        if len(self.block(block)[0]) > 4 * self.WIDTH:
            every = [self.block(b) for b in range(len(self.blocks))]
            self.__dict__ = SegmentTree.of([x for b in every for x in b[0]], [x for b in every for x in b[1]]).__dict__
        else:
            for b in range(block, last + 1):
                self._update(b)
        return len(fresh)

    def text(self) -> str:
        return "".join(x for b in range(len(self.blocks)) for x in self.block(b)[0])


def trees_of(raw: np.ndarray, offsets: np.ndarray, counter: Counter) -> Iterator[tuple[int, SegmentTree]]:
    """For each text of a slice its number of leaves and its tree."""
    starts = leaf_starts(raw, offsets)
    ends = np.append(starts[1:], len(raw))
    counts = counter.of_spans(raw, starts, ends)
    lead = (raw & 0xC0) != 0x80
    first = np.searchsorted(starts, offsets)
    size = np.diff(first)
    place = np.arange(len(starts)) - np.repeat(first[:-1], size)
    blocks = np.flatnonzero(place % SegmentTree.WIDTH == 0)
    sums = lambda x, at: np.add.reduceat(x, at, dtype=np.int64).tolist() if len(at) else []
    chars, tokens = sums(lead, starts[blocks]), sums(counts, blocks)
    edge = np.append(blocks, len(starts))
    own = np.searchsorted(blocks, first)

    def open_block(k: int) -> tuple[list[str], list[int]]:
        a, b = edge[k], edge[k + 1]
        return [raw[x:y].tobytes().decode() for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], counts[a:b].tolist()

    for r in range(len(offsets) - 1):
        a, b = int(own[r]), int(own[r + 1])
        yield int(size[r]), SegmentTree(chars[a:b], tokens[a:b], lambda k, a=a: open_block(a + k))


def _kernel(path: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            out, edits = [], batch["_edits"]
            for i, j, raw, offsets in column_slices(batch["_text"]):
                asked = edits.slice(i, j - i).to_pylist()
                for own, (n, tree) in zip(asked, trees_of(raw, offsets, counter), strict=True):
                    before, again = tree.total, 0
                    for e in own or ():
                        again += tree.edit(e["start"], e["end"], e["text"] or "", counter)
                    out.append((n, before, tree.total, again))
            values = np.array(out, np.int64).reshape(-1, 4)
            names = [n for n in batch.schema.names if n not in ("_text", "_edits")]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *(pa.array(values[:, k]) for k in range(4))], [*names, "n_leaves", "n_before", "n_after", "n_encoded_again"])
            release()
        del counter
        release()

    return kernel


def count_with_edits(docs: DataFrame, tokenizer: str, edits_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts before and after each document's edits.

    edits_col: array of struct(start, end, text), in order, in characters of the text as the edits before have left it;
    places outside the text are moved to its ends. `tokenizer` is the path of a file of the tokenizers library whose
    pre-tokens take at most one space before a word and otherwise never reach across white space.

    Returns one row for each row of docs: id_col, n_leaves, n_before, n_after, n_encoded_again (leaves encoded for edits).
    Null text is empty; null edits are none; a null replacement deletes. Repeated rows are counted each. Other columns
    are not read. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(edits_col).alias("_edits"))
    return given.mapInArrow(_kernel(tokenizer), f"id {kind}, n_leaves long, n_before long, n_after long, n_encoded_again long").withColumnRenamed("id", id_col)
