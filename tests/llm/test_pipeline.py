import random
from collections import Counter

import corpus_pipeline
from shelfcast.llm import toxicity
from tests.llm.fixtures import awkward, prose, stored
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import targets
from tests.llm.test_toxicity import corpus


def test_every_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = corpus(240)
    copies = [(2000 + i, rows[i][1] + "\n" + prose(rng, 12), "b") for i in range(20)]
    rows = rows + copies + [(3000 + i, t, s) for i, (_, t, s) in enumerate(awkward()) if len(t or "") < 5000]
    stored(spark, rows, tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, scores = docs.columns, {
        r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    }
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{i}")
        stage(spark, seen[-1], str(tmp_path)).write.parquet(path)
        seen.append(spark.read.parquet(path))
        assert i == len(corpus_pipeline.STAGES) - 1 or seen[-1].columns == columns
    clean, lined, single, mixed = ([(r["doc_id"], r["text"], r["source"]) for r in d.select("doc_id", "text", "source").collect()] for d in seen[1:5])
    packed = seen[5].collect()

    assert Counter(clean) == Counter(r for r in rows if not scores[r[0]]) and len(clean) < len(rows)
    want = brute_lines(clean)
    assert Counter((i, t) for i, t, _ in lined) == Counter((i, want[(False, i, t or "")]) for i, t, _ in clean)
    assert Counter(i for i, _, _ in single) == Counter(representatives(lined))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, s in single:
        sizes[s] += len(t.split())
        largest[s] = max(largest[s], len(t.split()))
    for _, t, s in mixed:
        taken[s] += len(t.split())
    for s, goal in targets(sizes).items():
        assert abs(taken[s] - goal) <= 2 * largest[s] + 1
    assert max(Counter(i for i, _, _ in mixed).values()) <= 2 and {r for r in mixed} <= set(single)
    ends = Counter(r["doc_id"] for r in packed if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == Counter(i for i, _, _ in mixed)
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def representatives(rows, words=5, similarity=0.8):
    """The smallest id of every group linked by the similarity of five-word runs, pair by pair."""
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= similarity * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def test_run_gives_the_last_stage(spark, tmp_path):
    rows, labels = corpus(60)
    stored(spark, rows, tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0
