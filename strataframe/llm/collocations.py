"""Phrase collocations from count streams in prefix and suffix order.

Texts become frames once: words of one language as numbers of the frame's own dictionary, written as a table. A phrase can
reach the least count only if its pairs of neighbouring words do, so frames first exchange their pairs and words as slim
keys; equal keys' counts add up, so a pair whose key stays below the least count cannot be frequent (two pairs under one key
only make it seem more frequent, and cost a little work). Under the pairs left, frames count phrases of one to four words
exactly, by their words.

The counts are one stream. Sorted by the words from the first on (prefix order), a phrase comes after all its prefixes, so
the count of its first k words is the last one of a k-word row before it: a running fill reads all left parts and the one
word extensions to the right in lockstep, without any join. Sorted by the words from the last on (suffix order) the same fill
gives the right parts and the extensions to the left. The streams are sorted by range, so the one thing a partition needs of
those before it is their last row of each length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import _FOLD, U64, column_slices, mix, release, word_hashes
from ._frames import among, drop_written, heads_of, packed_schema, packed_table, partitions, spans_of, written

LONGEST = 4
#: Text of a frame.
FRAME_BYTES = 6 << 20
#: Keys of the exchange that narrows phrases down: so many bits of a hash.
KEY_BITS = 40
#: Sorted count streams have partitions of about so many rows.
STREAM_ROWS = 500_000
#: Frames' worth of text that a task may hold of all languages together.
WAITING = 6
#: What parts words, and what parts pieces.
_GAP, _STOP = (0x20, 0x09), (*b".,;:!?", *range(0x0A, 0x0E))
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_GAP)] = 1
_CLASS[list(_STOP)] = 2


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The folded words of texts in order, and the number of the piece of each."""
    folded = _FOLD[raw]
    kind = _CLASS[folded]
    inside = kind == 0
    head = np.zeros(len(raw) + 1, bool)
    head[offsets] = True
    begin = inside & np.concatenate([[True], ~inside[:-1]]) if len(raw) else inside
    if len(raw):
        begin |= inside & head[:-1]
    starts = np.flatnonzero(begin)
    letters = np.flatnonzero(inside)
    edges = np.append(np.searchsorted(letters, starts), len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(folded[letters]))])
    return words, (np.cumsum(kind == 2) + np.cumsum(head[:-1]))[starts] if len(raw) else np.zeros(0, np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of their bytes, compressed: small ones take little."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _plain(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _lines(values: pa.Array) -> bytes:
    """Strings without line feeds, one a line, compressed."""
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\n")
    return zstandard.compress(joined[0].as_buffer(), 3)


def _split_lines(packed: bytes) -> pa.Array:
    """What _lines() got; no line is empty."""
    text = pa.array([zstandard.decompress(packed)], pa.binary()).cast(pa.string())
    lines = pa.compute.split_pattern(text, "\n").values
    return lines.filter(pa.compute.not_equal(lines, ""))


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for about FRAME_BYTES of a language: the text as numbers of words (0 between pieces), and the words."""
    waiting, sizes = defaultdict(list), defaultdict(int)

    def frame(lang: str) -> pa.RecordBatch:
        texts = pa.concat_arrays(waiting.pop(lang))
        sizes.pop(lang)
        words, pieces, base = [], [], 0
        for _, _, raw, offsets in column_slices(texts):
            some, piece = pieces_of(raw, offsets)
            words.append(some)
            pieces.append(piece + base)
            base += int(piece[-1]) + 1 if len(piece) else 0
        coded, piece = pa.concat_arrays(words).dictionary_encode(), np.concatenate(pieces)
        code = coded.indices.to_numpy()
        text = np.insert(code.astype(np.int64) + 1, np.flatnonzero(piece[1:] != piece[:-1]) + 1, 0)
        out = [pa.array([lang]), pa.array([len(code)], pa.int64()), pa.array([_packed(text)], pa.binary()), pa.array([_lines(coded.dictionary)], pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["lang", "n", "text", "words"])

    for batch in batches:
        langs = batch["lang"]
        for lang in pa.compute.unique(langs).to_pylist():
            texts = batch["text"].filter(pa.compute.equal(langs, lang))
            for i, j, raw, _ in column_slices(texts, FRAME_BYTES // 4):
                waiting[lang].append(texts.slice(i, j - i))
                sizes[lang] += len(raw)
                if sizes[lang] >= FRAME_BYTES:
                    yield frame(lang)
        while sum(sizes.values()) > WAITING * FRAME_BYTES:
            yield frame(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield frame(lang)
    release()


class _Frame:
    """Codes of a frame's text (0 between pieces, at its end too) and its words' and pairs' keys."""

    def __init__(self, frame: pa.RecordBatch | pa.Table):
        self.text = np.append(_plain(frame["text"][0].as_py()).astype(np.int64), 0)
        self.words, self.lang = _split_lines(frame["words"][0].as_py()), frame["lang"][0].as_py()
        self.base = len(self.words) + 1
        self.counts = np.bincount(self.text, minlength=self.base)[1:]
        lang = np.frombuffer(self.lang.encode(), np.uint8)
        self.seed = word_hashes(lang, np.array([0]), np.array([len(lang)]), fold=False)
        own = [word_hashes(raw, at[:-1], at[1:], fold=False) for _, _, raw, at in column_slices(self.words, FRAME_BYTES)]
        self.own = np.concatenate([np.zeros(1, U64), *own])
        self.word_key = mix(self.own[1:] ^ self.seed) >> U64(64 - KEY_BITS)
        self.first = np.flatnonzero((self.text[:-1] > 0) & (self.text[1:] > 0))
        pair = self.text[self.first] * self.base + self.text[self.first + 1]
        self.pair, self.pair_at, self.pair_count = np.unique(pair, return_inverse=True, return_counts=True)
        self.pair_key = self.key_of(self.pair // self.base, self.pair % self.base)

    def key_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(self.own[first] * U64(3) + mix(self.own[second] ^ self.seed)) >> U64(64 - KEY_BITS)


def _keys_out(buckets: int):
    """A frame's distinct keys and counts, for each bucket (a range of keys) the steps between its sorted keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                f = _Frame(one)
                keys, counts = np.concatenate([f.word_key, f.pair_key]), np.concatenate([f.counts, f.pair_count])
                del f
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
                heads = heads_of(keys)
                if not len(heads):
                    continue
                counts, keys = np.add.reduceat(counts, heads), keys[heads]
                bucket = (keys * U64(buckets)) >> U64(KEY_BITS)
                spans = spans_of(bucket)
                numbers = np.array([bucket[a] for a, _ in spans], np.int32)
                frame = np.full(len(spans), one["frame"][0].as_py(), np.int32)
                yield from packed_table(numbers, frame, [_packed(np.diff(keys[a:b], prepend=U64(0))) for a, b in spans], [_packed(counts[a:b]) for a, b in spans]).to_batches()
                release()

    return kernel


def _frequent(least: int):
    def kernel(table: pa.Table) -> pa.Table:
        own = [np.cumsum(_plain(x), dtype=U64) for x in table["c0"].to_pylist()]
        frame = np.repeat(table["frame"].to_numpy(), [len(x) for x in own])
        keys, counts = np.concatenate(own), np.concatenate([_plain(x) for x in table["c1"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts, frame = keys[order], counts[order].astype(np.int64), frame[order]
        heads = heads_of(keys)
        enough = np.add.reduceat(counts, heads) >= least if len(heads) else np.zeros(0, bool)
        hit = np.repeat(enough, np.diff(np.append(heads, len(keys))))
        # Keys come sorted, and stay so within a frame.
        frame, keys = frame[hit], keys[hit]
        order = np.argsort(frame, kind="stable")
        frame, keys = frame[order], keys[order]
        spans = spans_of(frame)
        return packed_table(np.zeros(len(spans), np.int32), frame[[a for a, _ in spans]].astype(np.int32), [_packed(np.diff(keys[a:b], prepend=U64(0))) for a, b in spans])

    return kernel


WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
COUNTED = "lang string, phrase string, f long"
BLOBS = "bucket int, lang string, phrases binary, counts binary"


def _phrases(buckets: int):
    """A frame's phrases of 1 to LONGEST words, all of whose pairs may be frequent, and their counts: a blob for each bucket.

    A bucket is a range of the key of a whole phrase, so no bucket is hot: a phrase comes to it once from each frame.
    """
    kinds = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def kernel(frame: pa.Table, told: pa.Table) -> pa.Table:
        if not frame.num_rows or not told.num_rows:
            return kinds.empty_table()
        f, pool = _Frame(frame.combine_chunks()), np.sort(np.concatenate([np.cumsum(_plain(x), dtype=U64) for x in told["c0"].to_pylist()]))
        good_word, good_pair = among(f.word_key, pool), among(f.pair_key, pool)
        kept = f.pair[good_pair]
        found = [([np.flatnonzero(good_word) + 1], f.counts[good_word]), ([kept // f.base, kept % f.base], f.pair_count[good_pair])]
        good, number = np.zeros(len(f.text) + LONGEST, bool), np.zeros(len(f.text), np.int64)
        good[f.first], number[f.first] = good_pair[f.pair_at], f.pair_at
        runs = good.copy()
        for size in range(3, LONGEST + 1):
            runs = runs[:-1] & good[size - 2 : size - 2 + len(runs) - 1]
            at = np.flatnonzero(runs)
            if not len(at):
                break
            _, one, back, counts = np.unique(number[at] * f.base + f.text[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
            number = np.zeros(len(f.text), np.int64)
            number[at] = back
            found.append(([f.text[at[one] + k] for k in range(size)], counts))
        codes = [np.concatenate([c[k] if k < len(c) else np.zeros(len(n), np.int64) for c, n in found]) for k in range(LONGEST)]
        counts = np.concatenate([n for _, n in found])
        if not len(counts):
            return kinds.empty_table()
        key = f.word_key[codes[0] - 1]
        for c in codes[1:]:
            key = np.where(c > 0, mix(key * U64(3) + f.own[c]) >> U64(64 - KEY_BITS), key)
        bucket = ((key * U64(buckets)) >> U64(KEY_BITS)).astype(np.int32)
        order = np.lexsort([*codes[::-1], bucket])
        bucket, counts = bucket[order], counts[order]
        names = pa.concat_arrays([pa.array([""], pa.string()), f.words])
        phrases = pa.compute.utf8_rtrim(pa.compute.binary_join_element_wise(*[names.take(pa.array(c[order])) for c in codes], " "), " ")
        spans = spans_of(bucket)
        return pa.table([pa.array(bucket[[a for a, _ in spans]], pa.int32()), pa.array([f.lang] * len(spans), pa.string()), pa.array([_lines(phrases[a:b]) for a, b in spans], pa.binary()), pa.array([_packed(counts[a:b]) for a, b in spans], pa.binary())], kinds)

    return kernel


def _added(least: int):
    """The counts of a bucket's phrases, those below least left out."""

    def kernel(table: pa.Table) -> pa.Table:
        phrases = [_split_lines(x) for x in table["phrases"].to_pylist()]
        langs = pa.concat_arrays([table["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(phrases)), [len(x) for x in phrases])))]).dictionary_encode()
        f = pa.array(np.concatenate([_plain(x) for x in table["counts"].to_pylist()]).astype(np.int64))
        sums = pa.table([langs.indices, pa.concat_arrays(phrases), f], ["k", "phrase", "f"]).group_by(["k", "phrase"]).aggregate([("f", "sum")])
        sums = sums.filter(pa.compute.greater_equal(sums["f_sum"], least))
        return pa.table([langs.dictionary.take(sums["k"].combine_chunks()), sums["phrase"], sums["f_sum"]], ["lang", "phrase", "f"])

    return kernel


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, w1 .. w4, f) of all phrases of 1 to 4 words with f >= least ("" beyond a phrase's end), and (lang, n) of all words."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = slim.mapInArrow(_frames, "lang string, n long, text binary, words binary").withColumn("at", F.monotonically_increasing_id())
    made = written(made, "phrase-texts")
    # Frames are numbered from the counts of each partition's, so that a number is 32 bits.
    per = made.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    base = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = made.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(per.select("part", base.alias("base"))), "part")
    frames = numbered.select((F.col("base") + F.col("at").bitwiseAND(2**33 - 1)).cast("int").alias("frame"), "lang", "text", "words")
    parts = partitions(spark)
    count = made.count()
    buckets = max(1, count if count <= parts else -(-count // parts) * parts)
    entries = frames.mapInArrow(_keys_out(buckets), packed_schema(2))
    told = entries.groupBy("bucket").applyInArrow(_frequent(least), packed_schema(1))
    blobs = frames.groupBy("frame").cogroup(told.groupBy("frame")).applyInArrow(_phrases(buckets), BLOBS)
    counted = blobs.groupBy("bucket").applyInArrow(_added(least), COUNTED)
    word = F.split("phrase", " ")
    counts = written(counted.select("lang", *[F.coalesce(F.get(word, F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(WORDS)], "f"), "phrase-counts")
    words = written(made.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
    drop_written(made)
    return counts, words


def _filled(size_of: str, outs: list[str]):
    """Each row's last f of a row of 1, 2 .. words before it in the partition, where it is longer; and the partition's number."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(LONGEST, np.int64)
        for batch in batches:
            size, f = batch[size_of].to_numpy(), batch["f"].to_numpy()
            n = np.arange(len(size))
            arrays = [batch.column(c) for c in batch.schema.names]
            for k in range(1, LONGEST):
                at = np.maximum.accumulate(np.where(size == k, n, -1))
                value = np.where(at >= 0, f[at], last[k])
                arrays.append(pa.array(value, pa.int64(), mask=(size <= k) | (value == 0)))
                last[k] = value[-1] if len(value) else last[k]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *outs])

    return kernel


def in_lockstep(stream: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """stream (lang, words, size, f) and prefix1 .. prefix3: the counts of its first 1 .. 3 words in the given order of words.

    All prefixes of a row are rows of stream.
    """
    spark = stream.sparkSession
    parts = max(-(-stream.count() // STREAM_ROWS), 1)
    parts = max(parts, min(parts * 8, partitions(spark)))
    dealt = stream.repartitionByRange(parts, "lang", *order).sortWithinPartitions("lang", *order).withColumn("part", F.spark_partition_id())
    outs = [f"{prefix}{k}" for k in range(1, LONGEST)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    found = written(dealt.mapInArrow(_filled("size", outs), kinds + "".join(f", {c} long" for c in outs)), f"phrase-{prefix}")
    # The last row of each length of the partitions before: a row for each partition.
    tails = found.groupBy("part").agg(*[F.max_by(F.when(F.col("size") == k, F.col("f")), F.when(F.col("size") == k, F.struct("lang", *order))).alias(f"tail{k}") for k in range(1, LONGEST)])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("part", *[F.last(f"tail{k}", True).over(before).alias(f"tail{k}") for k in range(1, LONGEST)])
    joined = found.join(F.broadcast(carry), "part")
    fill = {c: F.when(F.col("size") > k, F.coalesce(c, f"tail{k}")) for k, c in enumerate(outs, 1)}
    return joined.select(*stream.columns, *[fill[c].alias(c) for c in outs])


def _top(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group with their rank; parts of a group are cut to `most` rows first."""
    parts = partitions(df.sparkSession)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    cut = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).filter(F.col("rank") <= most)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("_part")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """The phrases of 2 to 4 words that belong together most, for each language.

    Letters A-Z are folded, pieces end at . , ; : ! ? and line ends, words at spaces and tabs. A phrase of f >= least has the
    lowest score of its cuts, floor(2000000 * f / (f(left part) + f(right part))), the first such cut on ties. Phrases inside
    a longer one that has at least `covered` per cent of their count are left out.

    Returns the first `most` of each language by score, count (both descending) and bytes: lang (null: und), rank, phrase, a
    (its count), l, r (its parts' counts), n (words of the language), score. Null and empty texts have no words. Texts of any
    length, repeated rows (each counts) and extra columns are fine. No rows, or no frequent phrase: no rows.
    """
    counts, words = phrase_counts(docs, least, text_col, lang_col)
    size = sum((F.col(w) != "").cast("int") for w in WORDS)
    own = F.filter(F.array(*WORDS), lambda w: w != "")
    back = [f"v{k}" for k in range(1, LONGEST + 1)]
    stream = counts.withColumn("size", size)
    left = in_lockstep(stream, WORDS, "l")
    turned = left.select("*", *[F.coalesce(F.get(F.reverse(own), F.lit(k)), F.lit("")).alias(v) for k, v in enumerate(back)])
    both = written(in_lockstep(turned, back, "r").drop(*back), "phrase-both")
    part = lambda prefix, k: F.get(F.array(*[f"{prefix}{j}" for j in range(1, LONGEST)]), k - 1)
    score = lambda k: F.expr(f"(cast(2000000 as decimal(10,0)) * cast(f as decimal(20,0))) div (cast(l{k} as decimal(20,0)) + cast(get(array(r1, r2, r3), size - {k} - 1) as decimal(20,0)))")
    cuts = F.array(*[F.when(F.col("size") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), part("r", F.col("size") - k).alias("r"))) for k in range(1, LONGEST)])
    phrases = both.filter("size >= 2")
    # A phrase of size - 1 words that its extension by one word covers: its words, from the left part and from the right part.
    longer = both.filter("size >= 3").withColumn("all", own)
    inner = lambda prefix, a: longer.filter(F.col("f") * 100 >= part(prefix, F.col("size") - 1) * covered).select("lang", F.slice("all", a, F.col("size") - 1).alias("all"))
    within = inner("l", 1).unionByName(inner("r", 2)).select("lang", *[F.coalesce(F.get("all", F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(WORDS)])
    left_out = phrases.join(within.distinct(), ["lang", *WORDS], "left_anti")
    best = F.array_min(F.filter(cuts, lambda c: c.isNotNull()))
    scored = left_out.select("lang", F.array_join(own, " ").alias("phrase"), F.col("f").alias("a"), best.alias("cut"))
    flat = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score"))
    top = _top(flat, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
