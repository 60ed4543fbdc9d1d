"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The features are densities of a lexicon (plain and behind character swaps), its proximity to second-person words, and
rates of capitals, punctuation and obfuscation. The lexicon is fixed seeds and the words that a bounded sample of the
labelled rows shows to go with the label. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import Words, column_slices, release, word_hashes
from ._frames import among, written

#: The trees, the calibration and the lexicon see about so many labelled rows at most, chosen by a hash of the id.
TRAIN_ROWS = 20_000
LEXICON_WORDS = 500
TREES, DEPTH, STEP = 12, 3, 0.3
NEAR = 5
#: Bytes of text at a time: a dozen running sums stand beside them.
SLICE = 1 << 19

#: Insults that count without any label.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "jerk", "fool", "bastard", "bitch", "asshole", "crap", "filth", "vermin", "retard", "whore", "slut", "connard", "salaud", "abruti", "crétin", "ordure", "arschloch", "trottel", "abschaum", "dummkopf", "imbécil", "estúpido", "basura", "cabrón")
#: Words that address the reader.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "vous", "votre", "vos", "du", "dich", "dir", "dein", "ihr", "euch", "usted", "ustedes", "vosotros", "tú", "ti")
#: Characters that stand for letters.
SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
FEATURES = ("log_words", "hits", "density", "swapped_hits", "swapped_density", "second_person", "near_second_person", "capitals", "shouted", "punctuation", "exclamations", "digits", "obfuscated")

_MARK = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}|<>-_*#~"))
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SWAPPED = np.arange(256, dtype=np.uint8)
_SWAPPED[[ord(c) for c in SWAPS]] = [ord(c) for c in SWAPS.values()]
_IS_SWAP = np.isin(np.arange(256), [ord(c) for c in SWAPS])


def _pool(words) -> np.ndarray:
    raw = [w.encode() for w in sorted(set(words))]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends, fold=True))


def _trimmed(raw: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without surrounding marks, however many; a word of marks alone keeps its first."""
    inner = np.flatnonzero(~_MARK[raw])
    if not len(inner):
        return words.starts, words.starts + 1
    first, last = np.searchsorted(inner, words.starts), np.searchsorted(inner, words.ends) - 1
    some = first <= last
    a = np.where(some, inner[np.minimum(first, len(inner) - 1)], words.starts)
    return a, np.where(some, inner[last] + 1, a + 1)


def features_of(raw: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    rows = len(offsets) - 1
    words = Words(raw, offsets, fold=True)
    count = np.diff(words.first).astype(float)
    size = np.diff(offsets).astype(float)
    a, b = _trimmed(raw, words)
    edge = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    digits, swaps, letters, upper = (edge(m[raw]) for m in (_DIGIT, _IS_SWAP, _LETTER, _UPPER))
    hit = among(word_hashes(raw, a, b, fold=True), lexicon)
    inner = lambda c: c[b] - c[a]
    mixed = (inner(swaps) > 0) & (inner(letters) > 0)
    swapped = np.zeros(len(words), bool)
    if mixed.any():
        swapped[mixed] = among(word_hashes(_SWAPPED[raw], a[mixed], b[mixed], fold=True), lexicon) & ~hit[mixed]
    you = among(word_hashes(raw, a, b, fold=True), second)
    shouted = (b - a > 1) & (inner(upper) == b - a)
    any_hit = hit | swapped
    near = np.zeros(len(words), bool)
    for d in range(1, NEAR + 1):
        if len(words) > d:
            together = words.row[d:] == words.row[:-d]
            near[d:] |= any_hit[d:] & you[:-d] & together
            near[:-d] |= any_hit[:-d] & you[d:] & together
    per = lambda mask: np.bincount(words.row[mask], minlength=rows).astype(float)
    chars = lambda m: (lambda c: (c[offsets[1:]] - c[offsets[:-1]]).astype(float))(edge(m[raw]))
    each, byte = np.maximum(count, 1), np.maximum(size, 1)
    bang = np.zeros(256, bool)
    bang[ord("!")] = True
    out = (np.log1p(count), per(hit), per(hit) / each, per(swapped), per(swapped) / each, per(you) / each, per(near) / each, chars(_UPPER) / byte, per(shouted) / each, chars(_PUNCT) / byte, chars(bang) / byte, chars(_DIGIT) / byte, per(mixed) / each)
    return np.stack(out, 1)


def _featurise(lexicon: tuple[str, ...]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, second = _pool(lexicon), _pool(SECOND_PERSON)
        for batch in batches:
            for i, j, raw, offsets in column_slices(batch["text"], SLICE):
                x = features_of(raw, offsets, words, second)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), batch["row"].slice(i, j - i), values], ["id", "row", "features"])
        release()

    return kernel


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _lexicon(sample: DataFrame) -> tuple[str, ...]:
    """Seeds, and words in at least 1 % of the labelled texts (5 or more) that are 20 times rarer in the others."""
    n1, n0 = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n1 or not n0:
        return SEEDS
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]{}|<>_*#~-]+|[.,;:!?\"'()\[\]{}|<>_*#~-]+$", "")))
    counts = sample.select("y", F.explode(words).alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    rate1, rate0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    found = counts.filter((F.length("w") > 2) & (F.col("a") >= max(5, n1 // 100)) & (rate1 >= 20 * rate0)).orderBy(F.desc(rate1 / rate0), "w").limit(LEXICON_WORDS)
    return (*SEEDS, *(r["w"] for r in found.collect()))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every text.

    Labels are learned only from rows that are not held out (crc32 of the id as text, modulo 5, is 0): about train_rows
    of them, remainder 1 for calibration and the rest for lexicon and trees. Nothing but the text enters a score.

    Returns one row for each row of docs: id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5). Null and empty
    texts are scored by their (zero) features. Rows that repeat an id are scored each; repeated labels count each. Null
    labels are not used. Without labels of both kinds the score is 1 for texts with a seed word and 0 for others. An
    empty table gives an empty table. Other columns are not read.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out("id"))
    n = usable.count()
    part = usable.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, train_rows / max(n, 1)))))
    part = part.withColumn("fold", F.crc32(F.col("id").cast("string").cast("binary")) % 5)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    if part.count() <= 2 * train_rows:  # else a few ids hold very many labels
        part = F.broadcast(part)
    sample = written(texts.join(part, "id").select("id", "y", "fold", "text"), "toxic-sample")
    lexicon = _lexicon(sample.filter("fold <> 1"))
    kind = docs.schema[id_col].dataType.simpleString()
    kernel, schema = _featurise(lexicon), f"id {kind}, row int, features array<double>"
    learned = sample.select("id", "text", (F.col("y") * 10 + F.col("fold")).cast("int").alias("row")).mapInArrow(kernel, schema)
    learned = written(learned.select(array_to_vector("features").alias("features"), F.floor(F.col("row") / 10).cast("double").alias("label"), (F.col("row") % 10).alias("fold")), "toxic-features")
    seen = {(r["fold"] == 1, int(r["label"])): r["count"] for r in learned.groupBy("fold", "label").count().collect()}
    every = texts.select("id", "text", F.lit(0).alias("row")).mapInArrow(kernel, schema)
    scored = every.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), array_to_vector("features").alias("features"), F.col("features").alias("raw"))
    if all(seen.get((fold, y)) for fold in (False, True) for y in (0, 1)):
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(learned.filter("fold <> 1"))
        margin = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1])
        curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(margin(learned.filter("fold = 1")).select("p", "label"))
        scored = curve.transform(margin(scored).select(id_col, "held_out", "p"))
        score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    else:
        score = (F.col("raw")[FEATURES.index("hits")] > 0).cast("double")
    return scored.select(id_col, "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
