"""Byte-level BPE against the tokenizers library, pre-token by pre-token and text by text."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.llm import bpe
from strataframe.llm._arrays import column_slices
from strataframe.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode, merge_by_rank, merge_rounds, pre_token_starts

tokenizers = pytest.importorskip("public_tokenizers")
BYTES = tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(BYTES)


def encoded(encoder, texts):
    import pyarrow as pa

    out = []
    for i, j, raw, offsets in column_slices(pa.array(texts, pa.string())):
        ids, edge = encoder.encode(raw, offsets)
        out += [ids[edge[k] : edge[k + 1]].tolist() for k in range(j - i)]
    return out


ALPHABET = ["'", "s", "t", "re", "ll", "ve", "'s", "'re", "d", "m", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "\x1c", "1", "²", "Ⅷ", "é", "é", "字", "字符", "🙂", "👩‍👩", "<|endoftext|>", "<|endoftext", "|>", ".", "--", "_", "A", "The", "the", "\x00", "Ᲊ", "\U000105c0", "\U0010fffd"]


def test_texts_of_awkward_parts(encoder, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    library = Tokenizer.from_file(BYTES)
    got = encoded(Encoder(BYTES), texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_has_the_library_class(encoder, library):
    """One pre-token for each character between letters, over all code points."""
    cut = library.pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 100_000):
        text = "".join(f"a{chr(c)}1{chr(c)}!" for c in points[a : a + 100_000])
        raw = np.frombuffer(text.encode(), np.uint8)
        byte_of = np.concatenate([[0], np.cumsum([len(x.encode()) for x in text])])
        want = [byte_of[s] for _, (s, _) in cut.pre_tokenize_str(text)]
        assert pre_token_starts(raw, np.array([0]), encoder.v.classes).tolist() == want


def test_long_words_and_both_merge_orders(encoder, library):
    rng = random.Random(5)
    words = ["a" * 5000, "ab" * 3000, "".join(rng.choice("etaoinshr") for _ in range(30_000)), "!" * 4001, "字" * 3000, "7" * 2049]
    assert encoded(encoder, words) == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    v = encoder.v
    for _ in range(200):
        raw = np.frombuffer("".join(rng.choice("aabtheinr") for _ in range(rng.randint(1, 60))).encode(), np.uint8)
        ids, _ = merge_rounds(v, v.byte_id[raw], np.zeros(len(raw), np.int64))
        assert ids.tolist() == merge_by_rank(v, v.byte_id[raw]).tolist()


def test_small_caches_and_many_slices(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    rng = random.Random(6)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(400)) for _ in range(900)]
    assert encoded(Encoder(BYTES), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        Vocabulary(tokenizers.path("word_bpe_49k.json"))


def test_frames_and_odd_rows(spark, library):
    texts = [None, "", "it's  a test\n", "<|endoftext|> x", "x" * 200_000, "same", "same", "žluťoučký 🙂 kůň"]
    rows = [(k, t, "clash", [1], "y") for k, t in enumerate(texts)] + [(None, "no id", "c", [], "y"), (3, "again", "c", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, ids array<int>, decoded string")
    out = bpe_encode(df, BYTES, decoded=True).collect()
    assert len(out) == len(rows)
    for r in out:
        source = next(t for k, t, *_ in rows if k == r.doc_id and (t or "") == r.decoded) or ""
        assert r.ids == library.encode(source, add_special_tokens=False).ids
        assert library.decode(r.ids, skip_special_tokens=False) == r.decoded
    assert bpe_encode(df.limit(0), BYTES).count() == 0
    odd = spark.createDataFrame([(1, [15496, 50256, 995], "old"), (2, None, "old"), (3, [], "old"), (4, [99_999, None, 220], "old"), (5, [160], "old"), (6, [-1], "old")], "k int, ids array<int>, decoded string")
    got = {r.k: r.decoded for r in bpe_decode(odd, BYTES).collect()}
    assert got == {1: "Hello<|endoftext|> world", 2: None, 3: "", 4: " ", 5: library.decode([160], skip_special_tokens=False), 6: ""}


def test_query_over_whole_documents(spark, library):
    import hashlib

    from strataframe.llm.queries import op11_bpe_round_trip

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = op11_bpe_round_trip(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))
