import random
import re

import numpy as np
import pytest

from shelfcast.llm import decontaminate as dc
from tests.llm.fixtures import awkward, frame, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    """(doc_id, words, hit words, item ids) of each document, window by window."""
    windows = {}
    for i, t in items:
        w = words_of(t)
        k = min(len(w), span)
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t, _ in docs:
        w, hit, names = words_of(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                found = windows.get(tuple(w[p : p + k]))
                if found:
                    hit |= set(range(p, p + k))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names)))
    return out


def corpus():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(10, 40))) for i in range(25)]
    items += [(100, "Tal, VO quen!"), (101, "ost"), (102, " ".join(f"nine{i}" for i in range(9))), (103, " ".join(f"five{i}" for i in range(5)))]
    items += [(104, None), (105, ""), (106, "... !!"), (None, prose(rng, 15)), (10, prose(rng, 12)), items[3], (107, items[3][1]), (108, "the " * 30), (109, "日本 語 é " * 5)]
    docs = awkward(many=40)
    for i in range(60):
        w = items[i % 25][1].split()
        a = rng.randrange(len(w) - 8)
        cut = w[a : a + rng.choice([8, 9, 10, 11, 30])]
        docs.append((500 + i, prose(rng, rng.randint(0, 8)) + "\n" + ", ".join(cut).upper() + " . " + prose(rng, rng.randint(0, 4)), "s0"))
    docs += [(700, "the " * 45, "s1"), (701, "x nine0 nine1 nine2 nine3 nine4 nine5 nine6 nine7 nine8", "s1"), (702, "five0 five1 five2 five3 five4", "s1"), (703, "x" + "five0 five1 five2 five3 five4", "s1")]
    docs += [(800 + i, items[2][1] + f" tail{i} " + "é 日本 語 " * 6, "s2") for i in range(200)] + [(900, items[1][1] + items[1][1], None), (901, items[7][1][:-1], None)]
    return docs, items


def item_frame(spark, items):
    return spark.createDataFrame([(*r, "row", 1, "hash") for r in items], "item_id long, text string, run string, k int, context string")


def test_against_brute_force(spark):
    docs, items = corpus()
    got = dc.overlaps(frame(spark, docs), item_frame(spark, items)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(brute(docs, items), key=key)
    for r in got:
        ends = [(s["a"], s["z"]) for s in r["spans"]]
        assert sum(z - a for a, z in ends) == r["n_hit"] and all(x[1] < y[0] for x, y in zip(ends, ends[1:])) and r["contaminated"] == (r["n_hit"] > 0)


def test_empty_tables(spark):
    docs, items = corpus()
    none = dc.overlaps(frame(spark, docs), item_frame(spark, [])).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] or r["items"] or r["spans"] for r in none)
    assert dc.overlaps(frame(spark, []), item_frame(spark, items)).count() == 0


@pytest.mark.parametrize("span,run", [(10, 5), (7, 3), (6, 6)])
def test_every_shared_span_has_a_fingerprint_on_both_sides(span, run):
    rng = random.Random(span)
    for _ in range(200):
        shared = [f"w{rng.randrange(3)}" for _ in range(span)]
        texts = [" ".join([f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 9))] + shared + [f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 9))]) for _ in range(2)]
        sets = []
        for t in texts:
            at, hashes = dc.winnow(dc.Words([t]), span, run)
            w = t.split()
            assert len(at) == len(hashes) and len(np.unique(at)) == len(at)
            sets.append({tuple(w[i : i + run]) for i in at.tolist()})
        assert {tuple(shared[i : i + run]) for i in range(span - run + 1)} & sets[0] & sets[1]


def test_words_and_hashes():
    texts = ["", "Ab c", "a,b;C d", "x" * 70000 + " é", "\x00\x7f", "c ab"]
    w = dc.Words(texts)
    for i, t in enumerate(texts):
        assert w.words(w.bounds[i], w.bounds[i + 1]) == words_of(t)
    names = w.words(0, len(w.start))
    assert all((a == b) == (x == y) for a, x in zip(names, w.hash, strict=True) for b, y in zip(names, w.hash, strict=True))
