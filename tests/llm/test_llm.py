"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm import _frames, minhash_dedup as mh, substring_dedup as sd
from strataframe.llm.decontamination import decontaminate
from strataframe.llm.embedding_dedup import embedding_dedup, quantised
from strataframe.llm.html_extraction import main_text, min_cut
from strataframe.llm.kd_sharding import kd_shards
from strataframe.llm.packing import WordTable, best_fit, pack
from strataframe.llm.quotation_linking import link_quotations
from strataframe.llm.token_counts import Counter, SegmentTree, count_with_edits, leaves_of
from strataframe.llm.toxicity import score_toxicity

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = tokenizers.path("word_bpe_49k.json")
BYTES = tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, frame int, bucket string, id string, row int"


def corpus(seed=0, n=60):
    """Invented texts with shared passages, near copies, exact copies and the edge cases."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [say(20), say(13), say(60)]
    texts = []
    for i in range(n):
        kind = i % 6
        base = say(rng.randint(1, 120))
        if kind == 1:
            base = base + "\n" + rng.choice(shared) + "  " + say(10)
        elif kind == 2 and texts:
            words = rng.choice([t for t in texts if t]).split()
            if words:
                words[rng.randrange(len(words))] = "changed"
            base = " ".join(words)
        elif kind == 3 and texts:
            base = rng.choice(texts)
        elif kind == 4:
            base = "same same " * rng.randint(1, 30) + base
        texts.append(base)
    texts += [None, "", "   \t", "one", "é ü 漢字 " * 30, "Mixed CASE word-with-dash " * 20, say(4000)]
    return [(i, t, "en", "s", len(t or ""), 1, "b", "x", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def small_frames(monkeypatch):
    monkeypatch.setattr(_frames, "FRAME_BYTES", 3000)
    monkeypatch.setattr(mh, "FRAME_ROWS", 9)
    monkeypatch.setattr(mh, "BUCKET_KEYS", 500)


def removed_by_hand(rows, window=13):
    first, out = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), i) < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode())
    return out


def test_substring_dedup(spark, docs, monkeypatch):
    small_frames(monkeypatch)
    got = sd.substring_dedup(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == removed_by_hand(corpus())
    assert {"frame", "bucket", "id", "row", "text"} <= set(got.columns)
    odd = spark.createDataFrame([(None, "a b c " * 9), (5, "x " * 20), (5, "x " * 20)], "doc_id long, text string")
    assert [r.n_removed for r in sd.substring_dedup(odd).collect()] == [0, 0, 0]
    assert sd.substring_dedup(docs.limit(0)).count() == 0


def linked_by_hand(rows):
    fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().translate(fold).split()
        sets[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("cell", [512, 2])
def test_minhash_dedup(spark, docs, monkeypatch, cell):
    small_frames(monkeypatch)
    monkeypatch.setattr(mh, "CELL", cell)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in mh.minhash_dedup(docs).collect()}
    assert got == linked_by_hand(corpus())
    assert mh.minhash_dedup(docs.limit(0)).count() == 0


def test_intersections_by_both_ways(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(1, 60, 30)).astype(np.uint64) for _ in range(12)]
    s = mh.Sets(np.concatenate(sets), np.array([len(x) for x in sets]))
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for dense in (1, 10**9):
        monkeypatch.setattr(mh, "DENSE_PAIRS", dense)
        assert mh.intersections(s, s).tolist() == want


def test_quotations(spark):
    rows = [(1, 0, "u", "Hello there\nSecond line"), (1, 1, "a", "> hello   THERE\nReply"), (1, 2, "u", "> > Hello there\n> Reply\nThanks"), (1, 3, "a", "> never said\nWhat"), (2, 0, "u", None), (None, 1, "u", "x"), (1, 1, "a", "> hello   THERE\nReply")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("line", F.lit(3))
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.parent_turn, r.thread) for r in link_quotations(d).collect()}
    assert got == {(1, 0): ("Hello there\nSecond line", 0, 0, None, 0), (1, 1): ("Reply", 1, 1, 0, 0), (1, 2): ("Thanks", 2, 2, 1, 0), (1, 3): ("What", 1, 0, None, 3), (2, 0): ("", 0, 0, None, 0)}
    assert link_quotations(d.limit(0)).count() == 0


def test_quoted_excerpts(spark):
    rows = [(1, 0, "One\nTwo\n\nThree\nFour\nFive"), (1, 1, "> two\n> THREE\nYes"), (1, 2, "> > Three\n> >\n> > Four\n> Yes\nMore"), (1, 3, "> Two\n> Four\nNot in a row"), (1, 4, "> Four\n> Two\nNor so"), (1, 5, "Two\nThree"), (1, 6, "> Two\n> Three\nThe latest"), (1, 7, "> One Two\n> Three Four Five\nWrapped anew"), (2, 0, "> Two\n> Three\nElsewhere")]
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn, r.thread) for r in link_quotations(spark.createDataFrame([(*r, "u") for r in rows], "conv_id int, turn int, text string, role string")).collect()}
    assert got == {(1, 0): (0, 0, None, 0), (1, 1): (1, 1, 0, 0), (1, 2): (2, 2, 1, 0), (1, 3): (1, 0, None, 3), (1, 4): (1, 0, None, 4), (1, 5): (0, 0, None, 5), (1, 6): (1, 1, 5, 5), (1, 7): (1, 1, 0, 0), (2, 0): (1, 0, None, 0)}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = pack(docs, WORDS, size=64, with_ids=True).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text, *_ in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want = [(k, a, ids[a : a + 64], zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert sorted((r.piece, r.start, r.ids, r.ids_crc32) for r in by[i]) == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= total / 64 * 1.1 + 2
    assert pack(docs.limit(0), WORDS).count() == 0


def test_packing_a_text_of_many_numbers(spark):
    from tokenizers import Tokenizer

    text = " ".join(map(str, range(1_000_000, 1_400_000)))
    ids = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids + [1]
    rows = pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORDS).collect()
    assert {r.piece: r.ids_crc32 for r in rows} == {k: zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for k, a in enumerate(range(0, len(ids), 4096))}


def test_word_table_grows_past_its_first_size():
    table, keys = WordTable(4), np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64)
    for a in range(0, 5000, 700):
        table.add(keys[a : a + 700], keys[a : a + 700] >> np.uint64(7), np.arange(a, min(a + 700, 5000)))
        assert 2 * table.size <= len(table.keys)
    assert (table.find(keys, keys >> np.uint64(7)) == np.arange(5000)).all() and (table.find(~keys, keys) == -1).all()
    assert (table.find(keys, keys) == -1).all()
    same = np.full(300, 77, np.uint64)
    table.add(same, np.arange(300, dtype=np.uint64), np.arange(300))
    assert (table.find(same, np.arange(300, dtype=np.uint64)) == np.arange(300)).all()


def test_best_fit_closes_the_fullest():
    bins, offsets = best_fit([6, 5, 8, 2, 4], 10, open_bins=2)
    assert bins == [0, 1, 2, 2, 1] and offsets == [0, 0, 0, 8, 5]


def test_edit_aware_counts(spark):
    counter = Counter(BYTES)
    full = lambda x: len(counter.tokenizer.encode(x, add_special_tokens=False).ids)
    rng = random.Random(2)
    for text in ["", "  ", " a  b\n\n c\t d  ", "don't stop  \n\n now " * 40, corpus()[-1][1]]:
        tree = SegmentTree.of(leaves_of(text), counter.counts(leaves_of(text)))
        for _ in range(15):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 5, 60]))
            new = "".join(rng.choice(["a", " ", "\n", "b ", " c", "'t"]) for _ in range(rng.randint(0, 4)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new, counter)
            assert tree.text() == text and tree.total == full(text)
    d = spark.createDataFrame([(1, "one two three", [(0, 3, "1")]), (2, None, None), (3, "x", [(5, 9, None)])], "doc_id int, text string, edits array<struct<start:int,end:int,text:string>>")
    got = {r.doc_id: (r.n_before, r.n_after) for r in count_with_edits(d, BYTES, "edits").collect()}
    assert got == {1: (full("one two three"), full("1 two three")), 2: (0, 0), 3: (1, 1)}


def test_main_text():
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>Menu</a></nav><div class='sidebar'>Read these other long stories from our pages today</div><article><h1>Title &amp; more</h1><p>First  para<br>goes on<p>Second<div class=ad>Buy now</div></article><section id=comments><p>I like this article very much indeed</p></section><footer>f</footer>"
    assert main_text(page) == "Title & more\nFirst para goes on\nSecond"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""


def test_min_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda lab: sum(abs(s) for s, x in zip(scores, lab, strict=True) if (s > 0) != x) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(min_cut(scores, edges)) == pytest.approx(best)


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = ["".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(30)]
        if bad:
            words[3], words[9] = rng.choice(["idiot", "1d1ot", "zorgon"]), "you"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "a " * 50000)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(d, y).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    plain = {r.doc_id: r.predicted for r in score_toxicity(d, y.limit(0)).collect()}
    assert plain[1000] == 0
    assert score_toxicity(d.limit(0), y).count() == 0


def test_decontamination(spark, docs):
    texts = [r[1] for r in corpus()]
    source = next(t for t in texts if t and len(t.split()) > 60).split()
    items = [(7, " ".join(source[5:25]).upper()), (12, "same same"), (3, None), (4, "nowhere to be found at all in these documents of ours")]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("term", F.lit("t"))
    cut = lambda t: ["".join(c if c.isalnum() or ord(c) > 127 else " " for c in w).split() for w in [(t or "")]][0]
    fold = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in cut(t)]
    wins = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = {}
    for i, t, *_ in corpus():
        w, hit, found = fold(t), set(), set()
        for x, owners in wins.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= owners
        want[i] = (len(w), len(hit), sorted(found))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == want
    near = decontaminate(docs, bench, slop=3).agg(F.sum("n_near"), F.sum(F.col("contaminated").cast("int"))).first()
    assert near[0] >= near[1] > 0
    assert decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 16))
    x = (base[rng.integers(0, 6, 90)] + rng.normal(size=(90, 16)) * 0.15).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(90, rows[0][1], 0), (91, [0.0] * 16, 0), (92, [float("nan")] * 16, 1), (93, None, 1), (94, rows[1][1], None), (95, [1.0, None], 2), (96, [], 2)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("block", T.IntegerType())])
    d = spark.createDataFrame([(*r, 1) for r in rows], schema)
    ok = [r for r in rows if r[0] <= 90]
    unit = np.array([r[1] for r in ok], np.float64)
    cos = unit @ unit.T / np.sqrt((unit**2).sum(1)[:, None] * (unit**2).sum(1)[None, :])
    links, root = collections.Counter(), {r[0]: r[0] for r in rows}
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            if ok[a][2] == ok[b][2] and cos[a, b] >= 0.93:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                low, high = sorted((root[ok[a][0]], root[ok[b][0]]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(d).collect()}
    assert sum(links.values()) > 0
    assert got == {r[0]: (links[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}
    assert embedding_dedup(d.limit(0)).count() == 0


def test_quantisation_bound():
    x = np.random.default_rng(7).normal(size=(50, 32))
    unit, codes, scale, error = quantised(x)
    bound = error[:, None] + (1 + error[:, None]) * error[None, :]
    assert (np.abs(unit @ unit.T - (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]) <= bound + 1e-12).all()


def test_kd_shards(spark, docs):
    rows = [(i, "x" * (i * 37 % 400), "en", "hot" if i % 3 else "s%d" % i, i % 50) for i in range(800)] + [(800, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit(9))
    got = kd_shards(d).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        text = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "bytes")
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) < 0.15 * np.mean(list(sizes.values()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards(d.limit(0)).count() == 0


def test_pipeline_stages_keep_what_they_must(spark, tmp_path):
    import corpus_pipeline as p

    rows = [r[:5] for r in corpus(9, 40)]
    insult = "you are an idiot and a moron " * 3
    rows += [(500 + i, f"{insult} {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(40)]
    passage = " ".join(f"bench{k}" for k in range(15))
    rows.append((900, "some words before " + passage, "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(500 <= r[0] < 540)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = rows
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(p.COLUMNS)
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            kept = [r for r in kept if not 500 <= r[0] < 540]
            assert set(got) == {r[0] for r in kept}
        elif name == "minhash_near_dedup":
            links = linked_by_hand(kept)
            kept = [r for r in kept if links[r[0]][2]]
            assert set(got) == {r[0] for r in kept}
        elif name == "substring_dedup":
            cut = removed_by_hand(kept)
            assert got == {r[0]: cut[r[0]][2] if cut[r[0]][1] else r[1] for r in kept}
        else:
            assert set(got) == {r[0] for r in kept} - {900}
    packed = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(got)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in p.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_words_of_the_sha_are_the_kept_words(spark):
    d = spark.createDataFrame([(1, "a b"), (2, " a\tb \n")], "doc_id long, text string")
    got = [r.h for r in sd.substring_dedup(d).select(F.sha2("kept_text", 256).alias("h")).collect()]
    assert set(got) == {hashlib.sha256(b"a b").hexdigest()}
