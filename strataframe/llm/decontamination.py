"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations alone.

Texts are split once: the postings (document, position, term) of all the benchmark's terms are stored, and nothing reads a
text again. Terms are counted from the postings. A window's places are its rarest term's positions less the term's offset;
they are intersected with the next rarest terms' lists at their own offsets, and then, in the postings of the documents that
are left, with the lists of all its other words. A place that all of them hold is an occurrence, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._frames import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How many posting lists of a window are intersected over the whole index before documents without a place are left out.
LISTS = 3
#: Up to so many rows and bytes a table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
#: Up to so many documents' numbers (8 bytes each) are broadcast to pick the postings that are still of interest.
BROADCAST_KEYS = 1_000_000
#: The term number of a document's end: its position is the number of words.
END = -1


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAPS), "")


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(words, item): the windows of each item."""
    split = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    size = F.size("words")
    starts = split.filter(size > 0).select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1)))).alias("at"))
    return starts.select("item", F.slice("words", F.col("at"), F.lit(window)).alias("words")).distinct().select("words", "item")


def _sized(df: DataFrame, measure: Column) -> DataFrame:
    """df, broadcast if its rows and bytes are within the bounds."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(measure)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def training_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index of terms (term, tid), as a stored table: doc (a number for each row of docs), pos (words before it), tid.

    The end of each row of docs is a posting too, of END, and has its id.
    """
    known = terms.unionByName(docs.sparkSession.createDataFrame([("", END)], "term string, tid long"))
    split = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("doc"), F.array_append(words_of(F.col(text_col)), F.lit("")).alias("words"))
    every = split.select("doc", "id", F.posexplode("words").alias("pos", "term"))
    met = every.join(_sized(known, F.octet_length("term") + 8), "term")
    return written(met.select("doc", "pos", "tid", F.when(F.col("tid") == END, F.col("id")).alias("id")), "postings")


def _of_documents(index: DataFrame, places: DataFrame) -> DataFrame:
    """The postings of documents that have a place."""
    concerned = places.select("doc").distinct()
    return index.join(F.broadcast(concerned) if concerned.count() <= BROADCAST_KEYS else concerned, "doc", "left_semi")


def exact_places(found: DataFrame, rare: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """win, doc, start, len of the places (win, doc, start, firsts) all of whose words' lists agree.

    firsts are LISTS of the window's terms, rarest first, whose lists (rare) are intersected first; the others' lists are
    read in the documents with a place left.
    """
    exact = found.filter("start >= 0")
    for k in range(1, LISTS):
        nth = F.col("firsts")[k]
        more = exact.filter(F.size("firsts") > k).withColumns({"tid": nth["tid"], "pos": (F.col("start") + nth["off"]).cast("int")})
        exact = exact.filter(F.size("firsts") <= k).unionByName(more.join(rare, ["tid", "doc", "pos"], "left_semi").drop("tid", "pos"))
    places = written(exact.select("win", "doc", "start"), "places")
    words = _sized(asked.select("win", "tids"), 8 * F.size("tids") + 32)
    wanted = places.join(words, "win").select("win", "doc", "start", F.size("tids").alias("len"), F.posexplode("tids").alias("off", "tid"))
    wanted = wanted.withColumn("pos", (F.col("start") + F.col("off")).cast("int")).drop("off")
    held = wanted.join(_of_documents(index, places), ["doc", "pos", "tid"])
    return held.groupBy("win", "doc", "start", "len").agg(F.count(F.lit(1)).alias("_held")).filter("_held = len").drop("_held")


def near_places(found: DataFrame, index: DataFrame, asked: DataFrame, slop: int) -> DataFrame:
    """win, doc, start of the places (start: where the window would begin by its rarest term) with all terms of the window,
    in any order, from slop words before that place to slop words after it."""
    places = written(found.select("win", "doc", "start").distinct(), "near-places")
    words = _sized(asked.select("win", "tids"), 8 * F.size("tids") + 32)
    wanted = places.join(words, "win").select("win", "doc", "start", F.size("tids").alias("len"), F.size(F.array_distinct("tids")).alias("_n"), F.explode(F.array_distinct("tids")).alias("tid"))
    held = wanted.join(_of_documents(index, places).select("doc", "pos", "tid"), ["doc", "tid"])
    inside = (F.col("pos") >= F.col("start") - slop) & (F.col("pos") < F.col("start") + F.col("len") + slop)
    return held.filter(inside).groupBy("win", "doc", "start", "_n").agg(F.count_distinct("tid").alias("_held")).filter("_held = _n").drop("_held", "_n")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, slop: int | None = None) -> DataFrame:
    """Find benchmark passages in documents.

    A window is `window` consecutive words of an item; a shorter item that has words is one window.

    Returns one row for each row of docs: id_col, n_words, n_hit (words inside any occurrence of a window), items (sorted
    item ids as strings, of items with an occurring window), contaminated; with slop also n_near, the places of windows
    (by their rarest term, first of equally rare ones by number) that have all terms of the window, in any order, within
    slop words. Null or empty texts have no words. An item without an id marks words but is in no list; repeated items are
    one. Rows that repeat an id are reported each by its own text. Empty tables give no hits or no rows. Other columns of
    either table are not read. Texts of any length are indexed whole.
    """
    every = written(item_windows(items, item_id, item_text, window), "item-windows")
    wins = written(every.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "window-numbers")
    terms = written(every.select(F.explode("words").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    index = training_index(docs, terms, id_col, text_col)
    counts = written(index.filter(F.col("tid") != END).groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "term-counts")

    # A window's terms, rarest first, each at its first place; windows with a term that no text has can't occur.
    place = wins.select("win", F.posexplode("words").alias("off", "term")).join(terms, "term").join(counts, "tid", "left")
    asked = place.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("off", "tid"))).alias("_all"), F.sort_array(F.collect_list(F.struct("n", "tid", "off"))).alias("_rare"), F.count("n").alias("known"), F.count(F.lit(1)).alias("size"))
    once = F.filter("_rare", lambda r, k: (k == 0) | (F.get("_rare", k - 1)["tid"] != r["tid"]))
    asked = written(asked.filter("known = size").select("win", F.col("_all.tid").alias("tids"), F.slice(once, 1, LISTS).alias("firsts")), "windows")
    wanted = asked.select(F.explode("firsts.tid").alias("tid")).distinct()
    rare = written(index.join(_sized(wanted, F.lit(8)), "tid").select("tid", "doc", "pos"), "rare-postings")

    lists = _sized(asked.select("win", "firsts", F.col("firsts")[0]["tid"].alias("tid")), F.lit(40 * LISTS))
    found = rare.join(lists, "tid").select("win", "firsts", "doc", (F.col("pos") - F.col("firsts")[0]["off"]).alias("start"))
    hits = written(exact_places(found, rare, index, asked), "hits")
    spans = hits.select("doc", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    upto = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(upto, F.lit(0))))
    covered = spans.withColumn("_new", fresh).groupBy("doc").agg(F.sum("_new").cast("long").alias("n_hit"))
    owners = hits.select("doc", "win").distinct().join(wins, "win").join(every, "words").groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = covered.join(owners, "doc")
    if slop is not None:
        near = near_places(found, index, asked, slop)
        told = told.join(near.groupBy("doc").agg(F.count(F.lit(1)).alias("n_near")), "doc", "full")
    told = _sized(written(told, "contaminated"), F.lit(64) + F.coalesce(F.octet_length(F.array_join("items", ",")), F.lit(0)))
    sizes = index.filter(F.col("tid") == END).select(F.col("id").alias(id_col), "doc", F.col("pos").cast("long").alias("n_words"))
    return sizes.join(told, "doc", "left").select(id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), *[F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")] * (slop is not None))
