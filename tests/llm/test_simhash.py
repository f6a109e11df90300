import random

import numpy as np
import pytest
import xxhash

from shelfcast.llm import simhash
from tests.llm.fixtures import awkward, frame


def brute_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_against_brute_force(spark):
    rows = awkward() + [(400, "ONE two Three", "a"), (401, "one TWO three", "b"), (402, "É é  x y z q", "c")]
    prints = [brute_print(t) for _, t, _ in rows]
    root = brute_components(prints)
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, p, least.get(r)) for (i, _, _), p, r in zip(rows, prints, root, strict=True)), key=str)
    docs = frame(spark, rows)
    got = sorted(((r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({v for v in least.values()}) and ids.count(None) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def clustered(n, seed=0):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            p = centre
            for _ in range(rng.randint(0, 7)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
    return sorted(out)[:n]


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_pairs(radius):
    prints = np.array(clustered(400), dtype=np.uint64)
    sizes = np.array([1, 63, 64, 65, 2, 205])
    group = np.repeat(np.arange(len(sizes)), sizes)
    rng = np.random.default_rng(1)
    rng.shuffle(prints)
    got = set()
    for a, b in simhash.close_pairs(prints, sizes, radius, most_jobs=300):
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and far[i, j] <= radius}
    assert got == want and (radius == 1 or want)


@pytest.mark.parametrize("radius", [0, 4, 30])
def test_bit_sliced_star(radius):
    prints = np.array(clustered(400), dtype=np.uint64)
    sizes = np.array([1, 63, 64, 65, 2, 205])
    first = np.cumsum(sizes) - sizes
    far = np.bitwise_count(prints ^ np.repeat(prints[first], sizes))
    assert sorted(simhash.close_to(prints[first], prints, sizes, radius)) == np.flatnonzero(far <= radius).tolist()


@pytest.mark.parametrize(("bands", "tile"), [(5, 2048), (6, 8), (8, 2048)])
def test_links_connect_the_same(spark, bands, tile):
    prints = clustered(300, seed=2)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.print_links(spark.createDataFrame([(p,) for p in signed], "print long"), 4, bands, tile).collect()
    from shelfcast.llm.components import connected

    roots = {r["u"]: r["root"] for r in connected(spark.createDataFrame(links or [], "u long, v long")).collect()}
    want = brute_components(prints)
    least = {}
    for s, r in zip(signed, want, strict=True):
        least[r] = min(least.get(r, s), s)
    assert [roots.get(s, s) for s in signed] == [least[r] for r in want]


def test_components_of_a_long_path(spark):
    from shelfcast.llm.components import connected

    edges = [(i + 1, i) for i in range(300)] + [(1000 + i, 999) for i in range(1, 200)]
    roots = {r["u"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 301)) and all(roots[1000 + i] == 999 for i in range(1, 200))
