"""Substring dedup by recompression.

Rounds give every maximal run and every left-right pair of neighbouring symbols a name that depends on nothing but the
named symbols, so it is the same in all documents, and equal substrings have equal interior symbols; they go on until a
text is one symbol. A first exchange finds the smallest document of each high-level symbol (LONG windows' words or more):
its occurrences in later documents are repeats as a whole. The same exchange finds the low-level symbols that two
documents have; a window outside the whole repeats is stood for by the deepest of these that its own words decide. So a
repeat is extended beyond its high-level symbols: its windows that hang over them, and those of short repeats, are named
in full under shared symbols only and exchanged to find each one's smallest document.

A window's smallest document never has it inside a whole repeat (a smaller document would have it too), so nothing is lost
by leaving those windows out. Frames of documents send each name once, so passages in very many documents stay small.
Names are 64-bit hashes of words, under a random key of the run, and of other names: unequal ones can't be made up
beforehand, and meet with a probability of 2**-64 a pair.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import U64, Words, column_slices, random_key, recompressed, trimmed, windows
from ._frames import among, distinct_keys, frames_for, heads_of, packed_by_frame, packed_schema, partitions, shared_in_bucket, text_bytes, to_buckets, unpacked

#: A symbol of this many windows' words or more is a whole repeat where a smaller document has it.
LONG = 2
#: What a frame is told of.
ANCHOR, SYMBOL, WINDOW = 0, 1, 2
RESULT = "n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    known = table["id"].is_valid().to_numpy()
    return table["id"].fill_null(0).to_numpy(), known


class _Slice:
    """Words, windows and long symbols of some rows of a frame."""

    def __init__(self, i: int, raw: np.ndarray, offsets: np.ndarray, window: int, with_anchors: bool, with_hashes: bool, key: int):
        self.raw, self.offsets = raw, offsets
        self.words = words = Words(raw, offsets, key=key)
        keys, self.begin, self.end, self.name = recompressed(words, window, LONG * window, with_anchors)
        last = max(len(words) - window + 1, 0)
        self.starts = np.flatnonzero(words.row[:last] == words.row[len(words) - last :])
        self.keys = keys[self.starts] if with_anchors else None
        self.value = windows(words, window)[1] if with_hashes else None
        self.rows, self.symbol_rows = words.row[self.starts] + i, words.row[self.begin] + i


def _joined(parts, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind, copy=False)


class _Frame:
    """The rows of one frame; rows without an id take part in nothing."""

    def __init__(self, table: pa.Table, window: int, key: int, with_anchors: bool = True, with_hashes: bool = True):
        self.window, (self.ids, self.known) = window, _ids(table)
        self.slices = [_Slice(i, raw, offsets, window, with_anchors, with_hashes, key) for i, _, raw, offsets in column_slices(table["text"])]

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Each long symbol's name and its smallest document in the frame."""
        use = [self.known[s.symbol_rows] for s in self.slices]
        names = _joined([s.name[u] for s, u in zip(self.slices, use, strict=True)], U64)
        return _smallest(names, _joined([self.ids[s.symbol_rows[u]] for s, u in zip(self.slices, use, strict=True)], np.int64))

    def of(self, name: str, use: list[np.ndarray]) -> np.ndarray:
        """value or keys of the windows in use."""
        return _joined([getattr(s, name)[u] for s, u in zip(self.slices, use, strict=True)], U64)

    def docs(self, use: list[np.ndarray]) -> np.ndarray:
        return _joined([self.ids[s.rows[u]] for s, u in zip(self.slices, use, strict=True)], np.int64)

    def settle(self, far: np.ndarray, far_doc: np.ndarray) -> list[np.ndarray]:
        """Mark whole repeats: slices get `covered`, words' edges. Returns which windows are still to be judged."""
        own, own_doc = self.symbols()
        pool, least = _smallest(np.concatenate([own, far]), np.concatenate([own_doc, far_doc]))
        out = []
        for s in self.slices:
            ids = self.ids[s.symbol_rows]
            later = self.known[s.symbol_rows]
            later[later] = least[np.searchsorted(pool, s.name[later])] < ids[later]
            a, b = s.begin[later], s.end[later]
            s.covered, inside = np.zeros(len(s.words) + 1, np.int64), np.zeros(len(s.words) + 1, np.int64)
            for edge, end in ((s.covered, b), (inside, b - self.window + 1)):
                np.add.at(edge, a, 1)
                np.add.at(edge, end, -1)
            out.append(self.known[s.rows] & (np.cumsum(inside)[s.starts] == 0))
        return out


def _smallest(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the smallest document of each."""
    if not len(values):
        return values, docs
    order = np.argsort(values, kind="stable")
    values, docs = values[order], docs[order]
    heads = heads_of(values)
    return values[heads], np.minimum.reduceat(docs, heads)


def _reveal(window: int, buckets: int, key: int):
    """Buckets below `buckets` get a frame's anchors, those from there on its long symbols."""

    def kernel(table: pa.Table) -> pa.Table:
        frame, number = _Frame(table, window, key, with_hashes=False), table["frame"][0].as_py()
        use = [frame.known[s.rows] for s in frame.slices]
        return pa.concat_tables([to_buckets(number, buckets, *distinct_keys(frame.of("keys", use), frame.docs(use))), to_buckets(number, buckets, *frame.symbols(), first=buckets)])

    return kernel


def _told_of(buckets: int):
    """Anchors that two documents have (ANCHOR), or the smallest documents of symbols (SYMBOL), to the frames concerned."""

    def kernel(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= buckets:
            return _first_document(table, SYMBOL)
        shared = shared_in_bucket(table)
        return shared.append_column("c1", pa.array([b""] * shared.num_rows, pa.binary()))

    return kernel


def _split(told: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = told.filter(pa.compute.equal(told["bucket"], kind))
    return unpacked(rows["c0"])[0], unpacked(rows["c1"], np.int64)[0]


def _name_windows(window: int, buckets: int, key: int):
    """The windows under shared anchors outside whole repeats; the long symbols' documents go through to their frame."""

    def kernel(table: pa.Table, told: pa.Table) -> pa.Table:
        through = told.filter(pa.compute.equal(told["bucket"], SYMBOL))
        through = through.set_column(0, "bucket", pa.compute.add(through["frame"], pa.scalar(buckets, pa.int32())))
        pool = np.sort(_split(told, ANCHOR)[0])
        if not table.num_rows or not len(pool):
            return through
        frame = _Frame(table, window, key)
        judged = frame.settle(*_split(told, SYMBOL))
        value, keys, docs = frame.of("value", judged), frame.of("keys", judged), frame.docs(judged)
        use = among(keys, pool)
        return pa.concat_tables([to_buckets(table["frame"][0].as_py(), buckets, *_smallest(value[use], docs[use])), through])

    return kernel


def _first_document(table: pa.Table, kind: int) -> pa.Table:
    """For each name of the bucket its smallest document, told to the frames whose own smallest is larger."""
    values, sizes = unpacked(table["c0"])
    docs, _ = unpacked(table["c1"], np.int64)
    frame = np.repeat(table["frame"].to_numpy(), sizes)
    order = np.argsort(values, kind="stable")
    values, docs, frame = values[order], docs[order], frame[order]
    heads = heads_of(values)
    least = np.repeat(np.minimum.reduceat(docs, heads), np.diff([*heads, len(values)])) if len(heads) else docs
    later = least < docs
    return packed_by_frame(frame[later], values[later], least[later], bucket=kind)


def _windows_told(buckets: int):
    def kernel(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < buckets:
            return _first_document(table, WINDOW)
        return table.set_column(0, "bucket", pa.array([SYMBOL] * table.num_rows, pa.int32()))

    return kernel


def _remove(window: int, key: int):
    def kernel(table: pa.Table, told: pa.Table) -> pa.Table:
        frame = _Frame(table, window, key, with_anchors=False)
        judged = frame.settle(*_split(told, SYMBOL))
        value, docs = frame.of("value", judged), frame.docs(judged)
        far, far_doc = _split(told, WINDOW)
        pool, least = _smallest(np.concatenate([value, far]), np.concatenate([docs, far_doc]))
        n_words, n_removed, kept, spans = [], [], [], []
        for s, use in zip(frame.slices, judged, strict=True):
            gone = use.copy()
            gone[use] = least[np.searchsorted(pool, s.value[use])] < frame.ids[s.rows[use]]
            np.add.at(s.covered, s.starts[gone], 1)
            np.add.at(s.covered, s.starts[gone] + window, -1)
            drop = np.cumsum(s.covered)[:-1] > 0
            for r in range(len(s.offsets) - 1):
                a, b = s.words.first[r], s.words.first[r + 1]
                own = s.raw[s.offsets[r] : s.offsets[r + 1]].tobytes().split()
                cut = drop[a:b]
                lost = int(cut.sum())
                n_words.append(b - a)
                n_removed.append(lost)
                if lost:
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    own = compress(own, ~cut)
                else:
                    spans.append([])
                kept.append(b" ".join(own))
        out = {name: table[name] for name in table.column_names if name not in ("frame", "text")}
        out |= {
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        }
        return pa.table(out)

    return kernel


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Remove every word covered by a window whose words also start in a document with a smaller id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Windows are judged on the input, not on what is left.

    Returns docs' columns and n_words, n_removed, kept_text (kept words joined by one space), removed (word spans).
    Columns of docs with these four names are replaced. Null or empty text: no words, empty kept_text. Rows without an
    id keep all words and are no source. Rows that repeat an id are one document to each other: none removes from the
    other. Documents below the window length keep everything. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts, key = partitions(spark), random_key()
    total = text_bytes(docs, text_col)
    frames = frames_for(total, spark)
    buckets = -(-frames // 2)
    fresh = {"n_words", "n_removed", "kept_text", "removed"}
    rest = [c for c in docs.columns if c.lower() not in fresh]
    framed = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col)), F.lit(frames)).cast("int").alias("frame"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in rest if c not in (text_col,)]).alias("rest"),
    ).repartition(parts, "frame")
    entries = framed.groupBy("frame").applyInArrow(trimmed(_reveal(window, buckets, key)), packed_schema(2))
    first = entries.groupBy("bucket").applyInArrow(trimmed(_told_of(buckets)), packed_schema(2)).repartition(parts, "frame")
    named = framed.groupBy("frame").cogroup(first.groupBy("frame")).applyInArrow(trimmed(_name_windows(window, buckets, key), 2), packed_schema(2))
    told = named.groupBy("bucket").applyInArrow(trimmed(_windows_told(buckets)), packed_schema(2)).repartition(parts, "frame")
    schema = T.StructType([framed.schema["id"], framed.schema["rest"], *T._parse_datatype_string(RESULT).fields])
    out = framed.groupBy("frame").cogroup(told.groupBy("frame")).applyInArrow(trimmed(_remove(window, key), 2), schema)
    columns = [F.col("rest").getField(c).alias(c) if c != text_col else F.col("kept_text").alias(text_col) for c in rest]
    return out.select(*columns, "n_words", "n_removed", "kept_text", "removed")
