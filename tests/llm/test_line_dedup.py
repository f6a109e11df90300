import random

from pyspark.sql import functions as F

from shelfcast.llm import line_dedup
from tests.llm.fixtures import awkward, frame, prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b, least):
    if a == b:
        return True
    return min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= 1 and edits(a, b) <= 1


def brute(rows, least=8):
    """Kept text of each distinct (doc_id, text)."""
    docs = sorted({(i is None, i or 0, t or "") for i, t, _ in rows})
    lines = [(k, n, x, x.split()) for k, (_, _, t) in enumerate(docs) for n, x in enumerate(t.split("\n"))]
    out = {}
    for at, (k, _, x, w) in enumerate(lines):
        gone = bool(w) and any(v and close(v, w, least) for *_, v in lines[:at])
        out.setdefault(k, []).append(None if gone else x)
    return {docs[k]: "\n".join(x for x in v if x is not None) for k, v in out.items()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    template = prose(rng, 12).split()
    for i in range(40):
        w = list(template)
        how = i % 4
        if how == 0:
            w[rng.randrange(12)] = f"x{i}"
        elif how == 1:
            w.insert(rng.randrange(13), f"y{i}")
        elif how == 2:
            del w[rng.randrange(12)]
        else:
            w[2], w[7] = f"z{i}", f"z{i}"
        rows.append((300 + i, " ".join(w) + "\n" + "the the the the the the the the" + " the" * (i % 3), "s1"))
    # Documents with doc_hash order decided by hash are avoided: ids are distinct but for repeated rows and the null id.
    rows = [r for r in rows if r[0] is not None or r[1]]
    docs = frame(spark, rows)
    want = brute(rows)
    for r in line_dedup.dedup_lines(docs).select("row.doc_id", F.col("row.text").alias("text"), "kept_text", "n_lines", "n_dropped").collect():
        text = r["text"] or ""
        assert r["kept_text"] == want[(r["doc_id"] is None, r["doc_id"] or 0, text)]
        assert r["n_lines"] == text.count("\n") + 1
    out = line_dedup.deduplicated(docs)
    assert out.schema.names == docs.schema.names and out.count() == len(rows)
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0


def test_long_line_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = frame(spark, [(1, long, "a"), (2, long + " more", "a"), (3, None, None)])
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert got == {1: long, 2: "", 3: ""}
    assert line_dedup.deduplicated(frame(spark, [])).count() == 0


def test_before_each(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (1, 5, 256, 257, 1000)], "a array<long>")
    for r in df.select("a", line_dedup.before_each(F.col("a")).alias("b")).collect():
        x = 0
        for v, b in zip(r["a"], r["b"], strict=True):
            assert b == x
            x ^= v
