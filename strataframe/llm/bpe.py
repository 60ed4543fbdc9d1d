"""Byte-level BPE in batched merge rounds over numpy arrays.

A slice of texts is cut into pre-tokens by classes of bytes; its distinct ones (told apart by their bytes) that are not yet
known become symbols of one flat array. Each round looks all neighbouring pairs up by binary search over the sorted keys of
the merges, takes every word's lowest rank and merges all its places; words without a pair leave the array. A pre-token of
more than LONG_WORD bytes would need very many rounds: its merges go through the ranks in ascending order instead, each
rank's places in one step, so the work is near linear in its length. Ids are put back into texts by one gather, and decoded
by another over the tokens' bytes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import column_slices, release
from ._frames import spans_of

#: Pre-tokens of more bytes than this are merged rank by rank.
LONG_WORD = 512
#: Distinct pre-tokens that a task keeps.
CACHED_WORDS = 300_000
#: What follows an apostrophe as a pre-token of its own.
SHORT_ENDINGS, LONG_ENDINGS = b"stmd", (b"re", b"ve", b"ll")
#: Unicode's White_Space.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, SPACE, OTHER = range(4)
_NONE = np.int64(2**62)


@lru_cache(1)
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, classes) of runs of characters of one class, as the tokenizers library has them.

    Characters that Python's own Unicode tables do not know, in the planes with assigned ones, are asked of the library.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        if kind == "Cn" and (c >> 16 < 4 or c >> 16 == 14):
            unknown.append(c)
    out[list(_WHITE)] = SPACE
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for mark, kind in (("a", LETTER), ("1", NUMBER)):
        starts = {a for _, (a, _) in cut.pre_tokenize_str("".join(mark + chr(c) + "\n" for c in unknown))}
        out[[c for k, c in enumerate(unknown) if 3 * k + 1 not in starts]] = kind
    heads = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return heads, out[heads]


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans `which` of flat end to end, and where each begins (one more entry)."""
    size = length[which].astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(start[which] - edge[:-1], size) + np.arange(edge[-1])], edge


class Vocabulary:
    """Merges, bytes of tokens and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char_of = dict(zip(shown, map(chr, shown), strict=True))
        hidden = [b for b in range(256) if b not in char_of]
        char_of |= {b: chr(256 + k) for k, b in enumerate(hidden)}
        byte_of = {c: b for b, c in char_of.items()}
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(made, merged, np.arange(len(merged)))
        if len(merged) and (np.maximum(made[left], made[right]) >= np.arange(len(merged))).any():
            raise ValueError("a merge comes before those that make its parts")
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), merged[order]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or normalise are not supported")
        self.added = {content.encode(): i for content, i in added.items()}
        self.find_added = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if added else None
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: c for c, i in self.added.items()}
        self.length = np.zeros(max(spelled) + 2, np.int64)
        for i, b in spelled.items():
            self.length[i] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(len(self.length))), np.uint8)
        heads, classes = character_classes()
        self.classes = np.repeat(classes, np.diff(np.append(heads, 0x110000)))

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; the rank is _NONE where there is no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids end to end, and where each begins. Ids that the vocabulary lacks are nothing."""
        last = len(self.length) - 1
        return _gather(self.bytes, self.start, self.length, np.where((ids >= 0) & (ids < last), ids, last))


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def byte_classes(raw: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each byte's character, for UTF-8."""
    out = classes[:256].copy()[np.minimum(raw, 0x7F)]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
        padded = np.append(raw, np.zeros(4, np.uint8)).astype(np.int64)
        code = padded[lead] & (0x7F >> size)
        for k in range(1, 4):
            code = np.where(size > k, code << 6 | (padded[lead + k] & 0x3F), code)
        kind = classes[np.minimum(code, 0x10FFFF)]
        out[lead] = kind
        for k in range(1, 4):
            more = (size > k) & (lead + k < len(raw))
            out[lead[more] + k] = kind[more]
    return out


def pre_token_starts(raw: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, sorted; each ends where the next begins. heads: first bytes of the texts that are not empty.

    A run of letters, of numbers or of other marks takes one space before it; white space before that is a pre-token, as is
    another white character right before a run; an apostrophe at the start of a run of marks takes its ending.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = byte_classes(raw, classes)
    head = np.zeros(len(raw) + 4, bool)
    head[heads] = True
    turn = head[: len(raw)].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(turn)
    solid = runs[kind[runs] != SPACE]
    after = solid[~head[solid] & (kind[solid - 1] == SPACE)]
    spaced = raw[after - 1] == 0x20
    turn[after[spaced]] = False
    turn[after[spaced] - 1] = True
    white = after[~spaced] - 1
    while len(white):
        inside = (raw[white] & 0xC0) == 0x80
        turn[white[~inside]] = True
        white = white[inside] - 1
    quote = np.flatnonzero((raw == 0x27) & turn)
    ends = np.append(raw, np.zeros(4, np.uint8))
    quote = quote[~head[quote + 1]]
    short = np.isin(ends[quote + 1], np.frombuffer(SHORT_ENDINGS, np.uint8))
    long = np.zeros(len(quote), bool)
    for x, y in LONG_ENDINGS:
        long |= (ends[quote + 1] == x) & (ends[quote + 2] == y) & ~head[quote + 2]
    for at, size in ((quote[short], 2), (quote[long], 3)):
        turn[at + 1] = False
        at = at[at + size < len(raw)] + size
        turn[at] = turn[at] | (kind[at] == LETTER)
    return np.flatnonzero(turn)


def merge_rounds(v: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, word) of words of symbols, each word's together and in order."""
    done = []
    while len(symbols):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        counts = np.diff(np.append(heads, len(word)))
        rank, made = v.pair(symbols[:-1], symbols[1:])
        rank[word[1:] != word[:-1]] = _NONE
        rank, made = np.append(rank, _NONE), np.append(made, 0)
        best = np.repeat(np.minimum.reduceat(rank, heads), counts)
        over = best == _NONE
        if over.any():
            done.append((symbols[over], word[over]))
        pick = np.flatnonzero((rank == best) & ~over)
        pick = _apart(pick, pick[1:] == pick[:-1] + 1)
        symbols[pick] = made[pick]
        keep = ~over
        keep[pick + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done:
        return symbols, word
    symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def _apart(places: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
    """Of places in order the first, third .. of each chain in which every one overlaps the next."""
    if not overlaps.any():
        return places
    n = np.arange(len(places))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~overlaps]), n, 0))
    return places[(n - first) % 2 == 0]


def merge_by_rank(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """The ids of one long word: ranks in ascending order, all places of a rank in one step."""
    n = len(symbols)
    symbols, following, before = np.append(symbols, 0), np.append(np.arange(1, n + 1), n), np.arange(-1, n)
    alive = np.append(np.ones(n, bool), False)
    at_rank, waiting, heap = np.full(n + 1, _NONE), {}, []

    def look(places: np.ndarray) -> None:
        rank, _ = v.pair(symbols[places], symbols[following[places]])
        rank[following[places] == n] = _NONE
        at_rank[places] = rank
        places = places[rank != _NONE]
        rank = rank[rank != _NONE]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        for a, b in spans_of(rank):
            r = int(rank[a])
            if r not in waiting:
                waiting[r] = []
                heappush(heap, r)
            waiting[r].append(places[a:b])

    look(np.arange(n))
    while heap:
        r = heappop(heap)
        places = np.unique(np.concatenate(waiting.pop(r)))
        places = places[alive[places] & (at_rank[places] == r)]
        places = _apart(places, places[1:] == following[places[:-1]])
        if not len(places):
            continue
        _, made = v.pair(symbols[places], symbols[following[places]])
        gone = following[places]
        symbols[places] = made
        alive[gone] = False
        following[places] = following[gone]
        before[following[places]] = places
        left = before[places]
        look(np.unique(np.concatenate([places, left[left >= 0]])))
    return symbols[:-1][alive[:-1]]


class Encoder:
    """Ids of slices of texts; each distinct pre-token is merged once while it is kept."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {c: k for k, c in enumerate(self.v.added)}
        self.flat = np.array(list(self.v.added.values()), np.int32)
        self.start, self.length = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)

    def _learn(self, words: list[bytes]) -> None:
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, owner = self.v.byte_id[raw], np.repeat(np.arange(len(words)), size)
        long = np.flatnonzero(size > LONG_WORD)
        first = np.cumsum(size) - size
        short = ~np.isin(owner, long) if len(long) else slice(None)
        ids, word = merge_rounds(self.v, symbols[short], owner[short])
        for k in long:
            some = merge_by_rank(self.v, symbols[first[k] : first[k] + size[k]])
            ids, word = np.concatenate([ids, some]), np.concatenate([word, np.full(len(some), k)])
        if len(long):
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
        length = np.bincount(word, minlength=len(words))
        base = len(self.start)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.slot.update(zip(words, range(base, base + len(words)), strict=True))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each text's begin (one more entry than texts)."""
        heads, special = offsets[:-1][offsets[:-1] < offsets[1:]], []
        if self.v.find_added and self.v.find_added.search(raw.tobytes()):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                special += [(a + m.start(), a + m.end()) for m in self.v.find_added.finditer(raw[a:b].tobytes())]
        if special:
            at = np.array(special, np.int64)
            heads = np.unique(np.concatenate([heads, at[:, 0], at[at[:, 1] < len(raw), 1]]))
        starts = pre_token_starts(raw, heads, self.v.classes)
        if special:
            inside = np.searchsorted(at[:, 0], starts, "right") - 1
            starts = starts[(inside < 0) | (starts == at[inside, 0]) | (starts >= at[inside, 1])]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        edges = np.append(starts, len(raw)).astype(np.int32)
        spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = spans.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) > CACHED_WORDS:
            self.clear()
        new = [w for w in words if w not in self.slot]
        if new:
            self._learn(new)
        slots = np.array([self.slot[w] for w in words], np.int64)[coded.indices.to_numpy()]
        ids, edge = _gather(self.flat, self.start, self.length, slots)
        return ids, edge[np.searchsorted(starts, offsets)]


def _texts(v: Vocabulary, ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The texts of runs of ids; bytes that are no UTF-8 become U+FFFD."""
    raw, at = v.spell(ids)
    offsets = at[edge]
    out = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def _encoded(path: str, decoded: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for i, j, raw, offsets in column_slices(batch["text"]):
                ids, edge = encoder.encode(raw, offsets)
                out = [batch["id"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*out, _texts(encoder.v, ids, edge)] if decoded else out, ["id", "ids", *["decoded"] * decoded])
        del encoder
        release()

    return kernel


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of whole texts, as the tokenizers library gives them without special tokens of a template.

    tokenizer is the path of a plain byte-level BPE file; strings of its added tokens in a text are those tokens. Truncation
    and padding of the file are not applied. Returns id_col and ids (array<int>), with decoded also the text that the ids
    stand for, one row for each row of docs, whatever its id. Null and empty texts have no ids. Texts and pre-tokens of any
    length are encoded whole. Other columns of docs are not read. No rows give no rows.
    """
    character_classes()
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(_encoded(tokenizer, decoded), f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def _decoded(path: str, ids_col: str, text_col: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            column = batch[ids_col]
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = column.flatten().fill_null(-1).to_numpy().astype(np.int64)
            texts = _texts(v, ids, np.concatenate([[0], np.cumsum(sizes)]))
            texts = pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            yield batch.append_column(text_col, texts)

    return kernel


def bpe_decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids. Special tokens are spelled; ids that the vocabulary lacks and nulls are nothing.

    Bytes that are no UTF-8 become U+FFFD. Null ids_col: null. A column of encoded named text_col is replaced.
    """
    character_classes()
    rest = encoded.drop(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(_decoded(tokenizer, ids_col, text_col), f"{kinds}, `{text_col}` string")
