"""Chat formatting by quotation linking.

Lines of a message are parsed for nested quote marks ('>' with any blanks between). A passage is a run of lines of one
level. Quoted passages are hashed after normalising and joined to the messages of the same conversation whose own lines,
or run of own lines, have that hash; an excerpt of several lines is looked up by its rarest two lines and compared with the
own lines around them. Blank lines do not count. The nearest earlier message that a first-level quote came from is the parent; each
thread of replies is then numbered from its first message, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._frames import drop_written, written

QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
MAX_DOUBLINGS = 40
BLOCK_TURNS = 4096
#: White space at either end of a text.
ENDS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def _normal(text: Column) -> Column:
    """A passage for comparison: lower case, white space as one blank, no surrounding blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed_lines(messages: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, line, level, body: each line with its quote level (0: the message's own) and without its marks."""
    lines = messages.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\r?\n")).alias("line", "raw"))
    marks = F.regexp_extract("raw", QUOTE, 1)
    return lines.select(*keys, "line", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("raw", QUOTE, "").alias("body"))


def _passages(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, level, body: maximal runs of lines of one level. A message's lines are one group, as long as its text."""
    order = Window.partitionBy(*keys).orderBy("line")
    change = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    runs = lines.withColumn("_c", change).withColumn("part", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    return runs.groupBy(*keys, "part", "level").agg(body.alias("body"))


def _pairs(lines: str) -> Column:
    """Hashes of each two neighbouring lines."""
    return F.zip_with(F.slice(lines, 1, F.size(lines) - 1), F.slice(lines, 2, F.size(lines)), lambda a, b: F.xxhash64(a, b))


def _excerpts(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """_conv, run_hash, hash: runs of own lines that hold all lines of a quoted passage one after another.

    Equal passages, and equal runs, of a conversation are compared once. A passage is looked up by its rarest two lines.
    """
    asked = asked.select("_conv", "hash", "lines").distinct()
    runs = runs.filter(F.size("_own") > 1).select("_conv", "run_hash", "_own").distinct()
    own_pairs = runs.select("_conv", "run_hash", F.posexplode(_pairs("_own")).alias("_at", "pair"))
    often = own_pairs.groupBy("_conv", "pair").agg(F.count(F.lit(1)).alias("_often"))
    pairs = asked.select("_conv", "hash", F.posexplode(_pairs("lines")).alias("_place", "pair")).join(often, ["_conv", "pair"])
    rarest = pairs.groupBy("_conv", "hash").agg(F.count(F.lit(1)).alias("_known"), F.min_by(F.struct("_place", "pair"), F.struct("_often", "_place")).alias("_r")).select("_conv", "hash", "_known", "_r.*")
    known = asked.join(rarest, ["_conv", "hash"]).filter(F.col("_known") == F.size("lines") - 1)
    met = known.join(own_pairs, ["_conv", "pair"]).filter("_at >= _place").join(runs, ["_conv", "run_hash"])
    same = F.slice("_own", F.col("_at") - F.col("_place") + 1, F.size("lines")) == F.col("lines")
    return met.filter(same).select("_conv", "run_hash", "hash").distinct()


def _latest(own: DataFrame, asked: DataFrame) -> DataFrame:
    """_conv, hash, _turn, _from of each asked (_conv, hash, _turn): the latest own turn before it with that hash.

    One pass in the order of turns, in blocks of BLOCK_TURNS; a block is told the last turn of the blocks before it.
    """
    block = F.floor(F.col("_turn") / BLOCK_TURNS)
    both = own.select("_conv", "hash", "_turn", F.lit(1).alias("_own")).unionByName(asked.select("_conv", "hash", "_turn", F.lit(0).alias("_own"))).distinct().withColumn("_block", block)
    upto = Window.partitionBy("_conv", "hash", "_block").orderBy("_turn", "_own").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("_own") == 1, F.col("_turn"))
    out = both.withColumn("_from", F.max(turn).over(upto)).filter("_own = 0")
    if not own.filter(F.col("_turn") >= BLOCK_TURNS).isEmpty():
        earlier = Window.partitionBy("_conv", "hash").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        tops = both.groupBy("_conv", "hash", "_block").agg(F.max(turn).alias("_top")).withColumn("_carried", F.max("_top").over(earlier)).drop("_top")
        out = out.join(tops, ["_conv", "hash", "_block"]).withColumn("_from", F.coalesce("_from", "_carried"))
    return out.filter("_from IS NOT NULL").select("_conv", "hash", "_turn", "_from")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with place: the message's number in its thread, from 0, in blocks of turns."""
    cell = ["_conv", "thread", "_block"]
    rows = rows.withColumn("_block", F.floor(F.col("_turn") / BLOCK_TURNS))
    before = Window.partitionBy("_conv", "thread").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("_turn"))
    return rows.withColumn("_number", number).join(first, cell).withColumn("place", (F.col("_first") + F.col("_number") - 1).cast("long"))


def conversations(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, thread, n_messages, text: each thread of link_quotations() as one document, its messages in reply order.

    A thread is one training document, so one row; a thread must fit in a row.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "formatted"))), lambda x: x["formatted"])
    return linked.groupBy(conv_col, "thread").agg(F.count(F.lit(1)).alias("n_messages"), F.array_join(ordered, "\n").alias("text"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without their quotes, linked to what they quote, in reply order.

    Returns one row for each (conversation, turn): conv_col, turn_col, role_col, text (own lines, without white space at
    either end), n_quotes
    (quoted passages that are not blank), n_linked (those found in an earlier message), parent_turn (the latest earlier
    message that a linked first-level passage came from, else of any level; null: it starts a thread), thread (the
    thread's first turn), place (the message's number in the thread, from 0) and formatted (the message in chat markup);
    conversations() puts each thread together. Rows with a null conversation or turn, and repeats of a (conversation, turn), are left out but for the
    smallest role and text. Null texts are empty. Passages equal in several earlier messages link to the latest. An empty
    table gives an empty table.
    """
    keys = ["_conv", "_turn"]
    base = messages.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    base = base.filter("_conv IS NOT NULL AND _turn IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("_role", "_text")).alias("m")).select(*keys, "m._role", "m._text")
    lines = parsed_lines(base, keys, "_text")
    by_line = F.filter(F.transform(F.split("body", "\n"), _normal), lambda x: x != "")
    parts = _passages(lines, keys).withColumns({"hash": F.xxhash64(_normal(F.col("body"))), "blank": _normal(F.col("body")) == "", "lines": F.transform(by_line, lambda x: F.xxhash64(x))})
    parts = written(parts, "passages")

    quoted = parts.filter("level > 0 AND NOT blank").select("_conv", "_turn", "part", "level", "hash", F.when(F.size("lines") > 1, F.xxhash64(F.lit(1), "lines")).alias("lines_hash"), "lines")
    runs = parts.filter("level = 0 AND NOT blank").select("_conv", "_turn", "hash", F.xxhash64("lines").alias("run_hash"), F.col("lines").alias("_own"))
    excerpts = _excerpts(quoted.filter("lines_hash IS NOT NULL").select("_conv", F.col("lines_hash").alias("hash"), "lines"), runs)
    own = runs.select("_conv", "_turn", F.explode(F.array_union(F.array("hash"), "_own")).alias("hash"))
    own = own.unionByName(runs.select("_conv", "_turn", "run_hash").join(excerpts, ["_conv", "run_hash"]).select("_conv", "_turn", "hash"))
    asked = quoted.select("_conv", "_turn", "part", "level", F.explode(F.array_compact(F.array("hash", "lines_hash"))).alias("hash"))
    links = asked.join(_latest(own, asked), ["_conv", "hash", "_turn"]).groupBy("_conv", "_turn", "part", "level").agg(F.max("_from").alias("_from"))
    parent = links.groupBy("_conv", "_turn").agg(F.count(F.lit(1)).alias("n_linked"), F.coalesce(F.max(F.when(F.col("level") == 1, F.col("_from"))), F.max("_from")).alias("parent_turn"))

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("part", "body")))), lambda x: x["body"]), "\n")
    texts = F.regexp_replace(joined, ENDS, "")
    plain = parts.groupBy(*keys).agg(texts.alias("text"), F.count_if((F.col("level") > 0) & ~F.col("blank")).alias("n_quotes"))
    out = written(base.drop("_text").join(plain, keys).join(parent, keys, "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0))), "linked")

    # The first turn of each thread: pointers to parents double their reach each round, while they have not ended at one.
    ahead = written(out.select("_conv", "_turn", F.coalesce("parent_turn", "_turn").alias("_root"), F.col("parent_turn").isNotNull().alias("_open")), "roots")
    for _ in range(MAX_DOUBLINGS):
        if ahead.filter("_open").isEmpty():
            break
        far = ahead.select("_conv", F.col("_turn").alias("_root"), F.col("_root").alias("_next"), F.col("_open").alias("_more"))
        moved = ahead.filter("_open").join(far, ["_conv", "_root"]).select("_conv", "_turn", F.col("_next").alias("_root"), F.col("_more").alias("_open"))
        last, ahead = ahead, written(ahead.filter("NOT _open").unionByName(moved), "roots")
        drop_written(last)
    formatted = F.concat(F.lit("<|"), F.coalesce("_role", F.lit("unknown")), F.lit("|>\n"), "text", F.lit("\n<|end|>"))
    rows = _placed(out.join(ahead.select("_conv", "_turn", F.col("_root").alias("thread")), keys))
    return rows.select(F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), F.col("_role").alias(role_col), "text", F.col("n_quotes").cast("long").alias("n_quotes"), F.col("n_linked").cast("long").alias("n_linked"), "parent_turn", "thread", "place", formatted.alias("formatted"))
