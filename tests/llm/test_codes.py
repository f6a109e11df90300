import hashlib
import math
import random

import numpy as np

from shelfcast.llm import codes

COLUMNS = "vec_id long, embedding array<float>, label int, part string, n string, v string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "n", "v", "c") for r in rows], COLUMNS)


def brute(rows, entries=16):
    """The contract in plain Python: (vec_id, label, code, error, label_error, hash) rows."""
    kept = []
    for i, x, label in rows:
        if x and len(x) % 8 == 0 and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(float(np.float32(c)) * 4096) for c in x], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = len(kept[0][1]) // 8
    cut = [[v[p * size : (p + 1) * size] for p in range(8)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(8)]

    def assign():
        out = []
        for c in cut:
            row = []
            for p in range(8):
                far = [sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]]
                row.append((min(far), far.index(min(far))))
            out.append(row)
        return out

    for _ in range(6):
        near = assign()
        for p in range(8):
            for e in range(len(books[p])):
                mine = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    near = assign()
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    errors = [sum(f for f, _ in n) for n in near]
    totals = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    return [(i, "".join(f"{c:02x}" for _, c in n), e, totals[label], digest) for (i, _, label), n, e in zip(kept, near, errors, strict=True)]


def result(spark, rows):
    got = codes.compress(frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def awkward(seed=2, many=120, width=16):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.choice([-0.25, 0.0, 0.125, rng.uniform(-1, 1)]) for _ in range(width)], rng.choice([0, 1, 2, None])) for i in range(many)]
    bad = [(1, None, 1), (2, [], 1), (4, [0.5] * 15 + [None], 1), (5, [float("nan")] * width, 2), (7, [float("inf")] + [0.0] * 15, 2), (8, [0.5] * 24, 0), (10, [0.1] * 7, 0)]
    return rows + bad + [rows[4], rows[4], (None, rows[7][1], None), (None, [0.5] * width, 1)] + [(1000 + i, rows[9][1], 3) for i in range(300)]


def test_against_brute_force(spark):
    rows = awkward()
    assert result(spark, rows) == sorted(brute(rows), key=str)


def test_few_rows_and_none(spark):
    few = [(5, [0.25, -0.5] * 4, 1), (2, [1.0, 0.0] * 4, 1), (2, [1.0, 0.0] * 4, None)]
    assert result(spark, few) == sorted(brute(few), key=str)
    assert result(spark, []) == [] and result(spark, [(1, None, 1)]) == []


def test_trie_equals_all_distances():
    rng = np.random.default_rng(4)
    leaves = rng.integers(-3, 4, (5000, 5))
    entries = rng.integers(-3, 4, (16, 5))
    far = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for order in (np.lexsort(leaves.T[::-1]), np.arange(5000)):
        for block in (1, 7, 8192):
            code, least = codes.nearest(leaves[order], entries, block)
            assert (code == far[order].argmin(axis=1)).all() and (least == far[order].min(axis=1)).all()


def test_hot_label_is_spread(spark):
    from pyspark.sql import functions as F

    from shelfcast.llm.common import spread_join

    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = spread_join(rows, side, ["k"], share=100).collect()
    assert len(got) == 3000 and all(r["n"] == (2000 if r["k"] is None else 1) for r in got)
