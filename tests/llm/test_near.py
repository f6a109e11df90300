import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import near
from shelfcast.llm.simhash import shingle_hashes
from tests.llm.fixtures import awkward, frame


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def kept_by_brute_force(rows):
    """One row of each component of exact five-word Jaccard similarity of 0.8."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [runs(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"edit{rng.randrange(10**9)}"
    return words


def near_rows(seed=1):
    """Texts with 0 to 6 edited words in 150, chains of edits, and a large group around one text."""
    rng, rows = random.Random(seed), []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(1000 + 10 * g + e, " ".join(edited(rng, base, e)), "a") for e in range(7)]
    chain = [f"c{i}" for i in range(150)]
    for i in range(12):
        rows.append((2000 + i, " ".join(chain), "b"))
        chain = edited(rng, chain, 2)
    base = [f"g{i}" for i in range(200)]
    rows += [(3000 + i, " ".join(edited(rng, base, 3)), "c") for i in range(100)]
    return rows


def test_stage_against_exact_similarity(spark, tmp_path):
    rows = awkward() + near_rows()
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), str(tmp_path))
    assert kept.columns == frame(spark, []).columns
    got = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert got == sorted(r[0] for r in kept_by_brute_force(rows) if r[0] is not None) and len(got) < len(rows) - 200


def test_rows_not_ids_decide(spark, tmp_path):
    one, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one, "s"), (1, other, "s"), (2, other, "s"), (None, one, "s")] + [(None, third, f"s{i}") for i in range(20)]
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == [(1, one), (1, other), (None, third)]


def test_recall_of_bands():
    rng, hit = random.Random(3), 0
    for _ in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        other = list(base)
        for i in (10, 60, 110, 160):
            other[i] = f"x{i}"
        assert 0.8 <= len(runs(" ".join(base)) & runs(" ".join(other))) / len(runs(" ".join(base)) | runs(" ".join(other))) < 0.83
        a, b = near.signatures([" ".join(base), " ".join(other)], 5)[2]
        hit += bool((np.array(a) == np.array(b)).any())
    assert hit == 300


def test_radius_holds_similar_pairs():
    """Pairs at similarity 0.8 to 0.83, of texts with 24 to 204 runs: the default radius holds all fingerprints."""
    rng, far = random.Random(4), []
    for _ in range(600):
        size = rng.choice([28, 54, 104, 208])
        base = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        other = base + [f"x{rng.randrange(10**9)}" for _ in range((size - 4) // 4)]
        a, b = (near.print_of(np.unique(shingle_hashes(" ".join(w), 5))) for w in (base, other))
        far.append(((a ^ b) & (2**64 - 1)).bit_count())
    assert max(far) <= 26 and sum(far) / len(far) > 5


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 4000, rng.integers(1, 50))) for k in range(70)]
    got = near.overlaps(sets, often=5, width=7)
    for i in range(70):
        for j in range(70):
            assert i == j or got[i, j] == len(set(sets[i]) & set(sets[j]))


def test_tiles_of_a_bucket_miss_no_link(spark):
    """Variants of one text that are pairwise below and above 0.8, in tiles of a few nodes."""
    rng = random.Random(8)
    base = [f"g{i}" for i in range(150)]
    rows = sorted({(i, " ".join(edited(rng, base, rng.randrange(3, 9))), "c") for i in range(150)})
    docs = near.keyed(frame(spark, rows))
    found = near.components(docs, most=2000, tile=8).groupBy("root").agg(F.min("id").alias("id")).collect()
    assert sorted(r["id"] for r in found) == [r[0] for r in kept_by_brute_force(rows)]


def test_every_link_passes_the_bit_sliced_comparison(spark):
    """Links of a bucket's smallest node, too, are found by fingerprints and then confirmed exactly."""
    rng = random.Random(9)
    base = [f"s{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, min(i, 2))), "c") for i in range(90)]
    prints = [near.print_of(np.unique(shingle_hashes(t, 5))) for _, t, _ in rows]
    docs = near.keyed(frame(spark, rows))
    assert near.components(docs).select("root").distinct().count() == len(kept_by_brute_force(rows)) == 1
    assert near.components(docs, radius=0).select("root").distinct().count() == len(set(prints)) > 1


def test_short_texts_stay_within_the_radius(spark):
    """Four runs against the same and one more: similarity 0.8, the most bits apart."""
    rng, rows = random.Random(10), []
    for g in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * g, " ".join(words[:8]), "a"), (2 * g + 1, " ".join(words), "a")]
    got = near.keep_one(frame(spark, rows)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(0, 800, 2))


def test_empty_table(spark):
    assert near.keep_one(frame(spark, [])).count() == 0
