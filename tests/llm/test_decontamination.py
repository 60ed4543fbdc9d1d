"""The positional index against plain search: exact and near places, repeats, nulls, short items, hot words and small bounds."""

import random
import re

import pytest

from strataframe.llm import decontamination as dc


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded) if w]


def windows(items, size):
    out = {}
    for item, text in items:
        w = words(text)
        for a in range(max(len(w) - size, 0) + 1) if w else ():
            out.setdefault(tuple(w[a : a + size]), set()).add(item)
    return out


def by_hand(docs, items, size):
    wins, out = windows(items, size), []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for a in range(len(w)):
            for n in range(1, size + 1):
                found = wins.get(tuple(w[a : a + n])) if a + n <= len(w) else None
                if found:
                    hit |= set(range(a, a + n))
                    owners |= found
        out.append((doc, len(w), len(hit), sorted(str(o) for o in owners if o is not None)))
    return sorted(out, key=repr)


def near_by_hand(docs, items, size, slop):
    """Places of a window's rarest term (any of equally rare ones: both counts are given) with all its terms around."""
    from collections import Counter

    count = Counter(w for _, t in docs for w in words(t))
    out = []
    for doc, text in docs:
        w = words(text)
        low = high = 0
        for win in windows(items, size):
            if any(count[x] == 0 for x in win):
                continue
            rarest = min(count[x] for x in win)
            found = []
            for term in {x for x in win if count[x] == rarest}:
                off = win.index(term)
                places = [p - off for p, x in enumerate(w) if x == term]
                found.append(sum(1 for s in places if set(win) <= set(w[max(s - slop, 0) : max(s + len(win) + slop, 0)])))
            low, high = low + min(found), high + max(found)
        out.append((doc, low, high))
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    vocab = ["the", "of", *(f"w{k}" for k in range(45)), "é", "字"]
    say = lambda n: [rng.choice(vocab[: rng.choice([3, 50])]) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(11, 25)))) for k in range(12)] + [(20, "Short one"), (21, "the"), (22, None), (23, "..."), (None, " ".join(say(14))), (3, " ".join(say(12)))]
    items += [items[0], items[0]]
    docs = []
    for k in range(90):
        w = say(rng.randint(0, 80))
        if k % 3 == 0:
            t = words(rng.choice(items)[1])
            a = rng.randint(0, max(len(t) - 8, 0))
            part = t[a : a + rng.randint(6, 16)]
            if k % 2:
                rng.shuffle(part)
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).title() if k % 5 else None if k % 2 else ""))
    docs += [docs[3], docs[3], (3, "another text of this id, short ONE"), (None, "no id but short one")]
    docs.append((500, " ".join(say(6000))))
    return docs, items


SCHEMA = "doc_id long, text string, doc int, pos string, tid string, id string"


@pytest.mark.parametrize("bound", [100_000, 1])
def test_exact_places(spark, made, monkeypatch, bound):
    docs, items = made
    for name in ("BROADCAST_ROWS", "BROADCAST_KEYS"):
        monkeypatch.setattr(dc, name, bound)
    df = spark.createDataFrame([(*d, 1, "x", "y", "z") for d in docs], SCHEMA).repartition(4)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, win int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(df, bench, window=10).collect()), key=repr)
    assert got == by_hand(docs, items, 10)


def test_near_places(spark, made):
    docs, items = made
    docs = [d for d in docs if d[0] is not None and d[0] != 3]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.n_near for r in dc.decontaminate(df, bench, window=8, slop=3).collect()}
    want = near_by_hand(docs, items, 8, 3)
    assert all(low <= got[doc] <= high for doc, low, high in want) and sum(got.values()) > 0
    assert sum(low == high > 0 for _, low, high in want) > 5
